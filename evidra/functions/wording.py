"""Texts of prompts and extractive answers, as formats; the facts in them come from the tables."""

GRAPH_NOTHING = "No bill shares a sponsor or committee with the topic of this question, so there is nothing to reason from. Assessment: insufficient evidence."
GRAPH_ANSWER = (
    '%s bill(s) are connected to this topic through shared sponsors and committees. The closest is %s ("%s"), which %s. '
    "Of the connected bills %s became law.\nAssessment: %s to pass, going by connected bills."
)
GRAPH_PROMPT = "Question: %s\n\nBills found by shared sponsors and committees:\n%s\n\nBase rate: %s\n\nAssess the question by these bills alone."
GRAPH_NO_CONTEXT = "(no connected bills found)"
BASE_RATE = "%s of these bills became law."
NO_BASE_RATE = "no outcomes known."

VECTOR_NOTHING = "No passage is similar to this question, so there is no text to reason from. Assessment: insufficient evidence."
VECTOR_ANSWER = (
    '%s passage(s) are most similar to this question. The closest (similarity %s) is from %s ("%s"). Outcomes of the matched bills: %s.\n'
    "Assessment: similar words alone; related by topic, no forecast."
)
VECTOR_PROMPT = "Question: %s\n\nMost similar passages:\n%s\n\nAssess the question by these passages alone."
VECTOR_NO_CONTEXT = "(no similar passages found)"
NO_OUTCOMES = "unknown"
#: What stands for a title that is missing.
NO_TITLE = "None"
