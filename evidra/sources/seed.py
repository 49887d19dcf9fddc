"""A small corpus of invented outcomes for tests and demonstrations: 16 bills of 6 people and 7 committees, and questions
with the bills that answer them. Titles, people, committees, outcomes and questions are fixed values that measures depend on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.sources.records import BILL, GOLDEN, keyed

#: id: name, party, state.
PEOPLE = {
    "H001": ("Rep. Jordan Hayes", "D", "CA"),
    "W001": ("Sen. Marcus Webb", "R", "TX"),
    "R001": ("Rep. Elena Ruiz", "D", "NY"),
    "N001": ("Sen. Priya Nair", "D", "WA"),
    "F001": ("Rep. Tom Fletcher", "R", "OH"),
    "K001": ("Sen. Grace Kim", "R", "FL"),
}
#: Name, chamber.
WAYS_MEANS = ("House Committee on Ways and Means", "House")
SENATE_FINANCE = ("Senate Committee on Finance", "Senate")
ENERGY_COMMERCE = ("House Committee on Energy and Commerce", "House")
SENATE_HELP = ("Senate Committee on Health, Education, Labor, and Pensions", "Senate")
HOUSE_JUDICIARY = ("House Committee on the Judiciary", "House")
SENATE_JUDICIARY = ("Senate Committee on the Judiciary", "Senate")
HOUSE_SCIENCE = ("House Committee on Science, Space, and Technology", "House")
#: Congress, type, number, title, sponsor, cosponsors, committees, outcome.
BILLS = [
    ("118", "hr", "410", "Prescription Drug Affordability Act", "R001", ["N001"], [ENERGY_COMMERCE, SENATE_HELP], "became_law"),
    ("118", "s", "88", "Rural Hospital Preservation Act", "N001", ["R001"], [SENATE_HELP], "passed_one_chamber_pending"),
    ("117", "hr", "1205", "Mental Health Access Expansion Act", "R001", ["N001", "H001"], [ENERGY_COMMERCE], "died_in_committee"),
    ("117", "s", "640", "Insulin Cost Reduction Act", "N001", ["R001"], [SENATE_HELP, SENATE_FINANCE], "died_after_passing_both_chambers"),
    ("118", "hr", "22", "Small Business Tax Relief Act", "F001", ["W001"], [WAYS_MEANS], "became_law"),
    ("118", "s", "150", "Corporate Tax Fairness Act", "W001", ["F001"], [SENATE_FINANCE], "died_in_committee"),
    ("117", "hr", "980", "Family Tax Credit Expansion Act", "F001", ["W001", "R001"], [WAYS_MEANS], "vetoed"),
    ("118", "hr", "700", "Clean Energy Investment Act", "H001", ["N001"], [ENERGY_COMMERCE, WAYS_MEANS], "passed_one_chamber_pending"),
    ("118", "s", "300", "Carbon Emissions Reduction Act", "N001", ["H001"], [SENATE_HELP], "died_in_committee"),
    ("117", "hr", "455", "Electric Vehicle Infrastructure Act", "H001", ["N001"], [ENERGY_COMMERCE], "became_law"),
    ("118", "hr", "512", "Consumer Data Privacy Act", "H001", ["K001"], [HOUSE_JUDICIARY, HOUSE_SCIENCE], "died_in_committee"),
    ("118", "s", "410", "Artificial Intelligence Accountability Act", "K001", ["H001"], [SENATE_JUDICIARY], "passed_one_chamber_pending"),
    ("117", "hr", "888", "Children's Online Safety Act", "K001", ["H001"], [HOUSE_JUDICIARY], "became_law"),
    ("118", "hr", "150", "Border Security and Modernization Act", "W001", ["R001"], [HOUSE_JUDICIARY], "died_after_passing_both_chambers"),
    ("118", "s", "222", "Dream Act Reauthorization", "R001", ["W001", "N001"], [SENATE_JUDICIARY], "died_in_committee"),
    ("117", "hr", "330", "Skilled Worker Visa Reform Act", "R001", ["W001"], [HOUSE_JUDICIARY, HOUSE_SCIENCE], "passed_one_chamber_pending"),
]
#: Questions, and the bills that answer them.
QUESTIONS = [
    ("How likely is a prescription drug pricing bill to become law?", ["118-HR-410", "117-S-640", "117-HR-1205", "118-S-88"]),
    ("What happened to past clean energy tax credit bills?", ["118-HR-700", "117-HR-455", "118-S-300"]),
    ("Will a consumer data privacy bill pass?", ["118-HR-512", "118-S-410", "117-HR-888"]),
    ("How have skilled worker visa bills fared?", ["117-HR-330", "118-HR-150", "118-S-222"]),
    ("Are small business tax relief bills likely to pass?", ["118-HR-22", "118-S-150", "117-HR-980"]),
    ("What is the outlook for mental health coverage legislation?", ["117-HR-1205", "118-HR-410", "118-S-88"]),
]


def seed_bills(spark: SparkSession) -> DataFrame:
    """The corpus as nested records, with their place; a summary says the title in other words."""
    rows, places = [], {}
    for congress, kind, number, title, sponsor, cosponsors, committees, outcome in BILLS:
        key = f"{congress}-{kind.upper()}-{number}"
        places[key] = len(places)
        crew = [(p, *PEOPLE[p]) for p in (sponsor, *cosponsors)]
        summary = f"A measure on {title.removesuffix(' Act').lower()}" + (", citizenship and asylum." if key == "118-S-222" else ".")
        dates = "2021-03-15" if congress == "117" else "2023-03-15"
        rows.append((congress, kind, number, title, dates, crew[0], crew[1:], committees, None, summary, [], ("2024-01-10", None), outcome))
    order = F.element_at(F.create_map(*(F.lit(x) for k, i in places.items() for x in (k, i))), F.col("bill_id"))
    return keyed(spark.createDataFrame(rows, BILL)).withColumn("ordinal", order)


def golden(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(q, r, None) for q, r in QUESTIONS], GOLDEN)
