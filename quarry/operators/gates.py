"""Quality gates for training passages and for generated question-answer pairs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.text import count_of, has_any, let, strip

#: What marks references, front matter and committee lists.
PASSAGE_MARKS = [
    "references", "doi:", " et al.", "accessed ", "isbn", "all rights reserved", "creative commons", "guideline group",
    "peer review", "committee", "chaired", "level of evidence", "recommended as of",
]
#: Questions about the document instead of its content, and answers that only point elsewhere.
QUESTION_MARKS = [
    "what is the focus of the article", "who chaired", "who published", "what organization published",
    "what was the comparison made", "what are some complications",
]
ANSWER_MARKS = ["as detailed in recommendation", "see recommendation", "the article focuses on"]
LEAST_PASSAGE, MOST_BARS, MOST_LINKS, LEAST_QUESTION, LEAST_ANSWER = 120, 12, 1, 20, 12


def good_passage(text: Column) -> Column:
    """Long enough, without any mark, not a table, at most one link."""
    return let(
        strip(F.lower(text)),
        lambda plain: (F.length(plain) >= LEAST_PASSAGE)
        & ~has_any(plain, PASSAGE_MARKS)
        & (count_of(plain, "|") <= MOST_BARS)
        & (count_of(plain, "http") <= MOST_LINKS),
    )


def good_pair(question: Column, answer: Column) -> Column:
    """Both present and long enough, neither with a mark."""
    good_question = let(strip(F.lower(question)), lambda q: (F.length(q) >= LEAST_QUESTION) & ~has_any(q, QUESTION_MARKS))
    good_answer = let(strip(F.lower(answer)), lambda a: (F.length(a) >= LEAST_ANSWER) & ~has_any(a, ANSWER_MARKS))
    return good_question & good_answer
