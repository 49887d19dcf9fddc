"""Functions of bill records: ids, labels, outcome, dates, subjects."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidra.functions.text import matches
from evidra.functions.vocabulary import BILL_TYPES, ENACTED, OUTCOMES, POLICY_AREAS


def _map(d: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for x in chain.from_iterable(d.items())))


def bill_id(congress: Column, kind: Column, number: Column) -> Column:
    """``{congress}-{TYPE}-{number}``; null if a part is, so that such rows can be left out."""
    return F.concat(congress.cast("string"), F.lit("-"), F.upper(kind), F.lit("-"), number.cast("string"))


def outcome_label(outcome: Column) -> Column:
    return F.when(F.coalesce(outcome, F.lit("")) == "", "Unknown").otherwise(F.coalesce(F.element_at(_map(OUTCOMES), outcome), outcome))


def is_enacted(outcome: Column) -> Column:
    return F.coalesce(outcome == ENACTED, F.lit(False))


def enactment_rate(outcome: Column) -> Column:
    """An aggregate: the share that became law; null over no rows."""
    return F.avg(F.when(is_enacted(outcome), 1.0).otherwise(0.0))


def verdict(rate: Column) -> Column:
    return F.when(F.coalesce(rate, F.lit(0.0)) >= 0.5, "likely").otherwise("unlikely")


def ordinal(n: Column) -> Column:
    ten, one = n % 100, n % 10
    suffix = F.when((ten >= 10) & (ten <= 20), "th").when(one == 1, "st").when(one == 2, "nd").when(one == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), suffix)


def type_short(kind: Column) -> Column:
    kind = F.coalesce(kind, F.lit(""))
    return F.coalesce(F.element_at(_map({k: v[0] for k, v in BILL_TYPES.items()}), F.lower(kind)), F.upper(kind))


def type_name(kind: Column) -> Column:
    return F.coalesce(F.element_at(_map({k: v[1] for k, v in BILL_TYPES.items()}), F.lower(F.coalesce(kind, F.lit("")))), F.when(kind != "", kind), F.lit("bill"))


def citation(congress: Column, kind: Column, number: Column) -> Column:
    """'H.Res. 1102 (118th)'."""
    congress = congress.cast("string")
    n = congress.try_cast("int")
    tail = F.when(F.coalesce(congress, F.lit("")) == "", "").otherwise(F.concat(F.lit(" ("), F.coalesce(ordinal(n), congress), F.lit(")")))
    return F.concat(type_short(kind), F.lit(" "), number.cast("string"), tail)


def congress_end(congress: Column) -> Column:
    """January 3 of the year in which a congress ends; null if it isn't a number."""
    return F.make_date(F.lit(1789) + (congress.cast("string").try_cast("int") - 1) * 2 + 2, F.lit(1), F.lit(3))


def has_ended(congress: Column, as_of: Column) -> Column:
    return F.coalesce(as_of > congress_end(congress), F.lit(False))


def congress_span(congress: Column) -> Column:
    """The years shown beside a congress: 1788 + 2n to 1789 + 2n (a year after the first of ``congress_end``'s span); null if
    it isn't a number."""
    n = congress.cast("string").try_cast("int")
    return F.concat((1788 + 2 * n).cast("string"), F.lit("-"), (1789 + 2 * n).cast("string"))


def first_year(congress: Column) -> Column:
    return 1789 + (congress.cast("string").try_cast("int") - 1) * 2


def outcome_of(actions_text: Column, ended: Column) -> Column:
    """The outcome that the texts of all actions, put together, tell; the strongest phrase decides."""
    t = F.lower(F.coalesce(actions_text, F.lit("")))
    senate, house = t.contains("passed senate"), t.contains("passed house")
    return (
        F.when(t.contains("became public law"), "became_law")
        .when(t.contains("vetoed"), "vetoed")
        .when(senate & house & ended, "died_after_passing_both_chambers")
        .when(senate & house, "passed_both_chambers_pending")
        .when((senate | house) & ended, "died_after_passing_one_chamber")
        .when(senate | house, "passed_one_chamber_pending")
        .when(ended, "died_in_committee")
        .otherwise("pending_in_committee")
    )


def subjects(text: Column, existing: Column, most: int = 4) -> Column:
    """Existing subjects, lower-cased, then the policy areas with most terms in the text, without repeats."""
    words = F.array_distinct(matches(text, "[a-z]+"))
    areas = F.array(*(F.struct((-F.size(F.array_intersect(words, F.lit(terms)))).alias("minus"), F.lit(i).alias("place"), F.lit(area).alias("area")) for i, (area, terms) in enumerate(POLICY_AREAS.items())))
    hit = F.slice(F.array_sort(F.filter(areas, lambda a: a["minus"] < 0)), 1, most)
    have = F.filter(F.transform(F.coalesce(existing, F.array().cast("array<string>")), F.lower), lambda x: x.isNotNull())
    return F.array_distinct(F.concat(have, F.transform(hit, lambda a: a["area"])))
