"""Vocabularies and labels that results depend on."""

STOP_WORDS = [
    "the", "a", "an", "of", "to", "for", "and", "or", "in", "on", "is", "are", "how", "what", "will", "this", "that",
    "bill", "act", "would", "likely", "pass", "passed", "similar", "bills", "happen", "happened", "new", "about",
]

#: Policy areas and their terms, in the order that breaks ties.
POLICY_AREAS = {
    "taxation": ["tax", "taxation", "irs", "revenue", "deduction", "credit"],
    "healthcare": ["health", "healthcare", "medicare", "medicaid", "insurance", "drug"],
    "immigration": ["immigration", "immigrant", "visa", "border", "asylum", "citizenship"],
    "defense": ["defense", "military", "armed", "veterans", "security", "weapon"],
    "environment": ["environment", "climate", "emissions", "energy", "pollution", "clean"],
    "education": ["education", "school", "student", "college", "teacher", "tuition"],
    "technology": ["technology", "internet", "data", "privacy", "cyber", "artificial"],
    "labor": ["labor", "wage", "worker", "employment", "union", "workplace"],
    "trade": ["trade", "tariff", "export", "import", "commerce", "customs"],
    "finance": ["bank", "finance", "financial", "securities", "credit", "loan"],
    "agriculture": ["agriculture", "farm", "crop", "rural", "food", "livestock"],
    "housing": ["housing", "rent", "mortgage", "homeless", "affordable", "tenant"],
}

OUTCOMES = {
    "became_law": "Became law",
    "vetoed": "Vetoed",
    "died_after_passing_both_chambers": "Passed both chambers, then died",
    "passed_both_chambers_pending": "Passed both chambers (pending)",
    "died_after_passing_one_chamber": "Passed one chamber, then died",
    "passed_one_chamber_pending": "Passed one chamber (pending)",
    "died_in_committee": "Died in committee",
    "pending_in_committee": "Pending in committee",
}
ENACTED = "became_law"

BILL_TYPES = {
    "hr": ("H.R.", "House Bill"),
    "s": ("S.", "Senate Bill"),
    "hres": ("H.Res.", "House Resolution"),
    "sres": ("S.Res.", "Senate Resolution"),
    "hjres": ("H.J.Res.", "House Joint Resolution"),
    "sjres": ("S.J.Res.", "Senate Joint Resolution"),
    "hconres": ("H.Con.Res.", "House Concurrent Resolution"),
    "sconres": ("S.Con.Res.", "Senate Concurrent Resolution"),
}

HTML_ENTITIES = [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&#8217;", "'"), ("&quot;", '"')]
