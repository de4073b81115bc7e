"""Prompts and training records, built as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.answers import cited
from quarry.functions.text import after, before, strip

RULE = "\n\n---\n\n"

#: The texts of the prompts. They differ in the words about sources and in blank lines.
ROLE = "You are a medical document QA assistant.\n"
UNKNOWN = "I don't know based on the provided documents."
BELOW, PROVIDED = "- Use ONLY the SOURCES below.\n", "- Use ONLY the SOURCES provided.\n"
UNSUPPORTED = f'- If the answer is not clearly supported by the sources, say: "{UNKNOWN}"\n'
CITE_SUPPORTED = "- Cite sources like [S1], [S2] next to supported claims.\n"
CITE_IN_ANSWER = "- In your answer, cite sources like [S1], [S2] next to the claims they support.\n"
CITE_CLAIMS = "- Cite sources like [S1], [S2] next to the claims they support.\n"
CONCISE = "- Keep the answer concise and factual.\n"
HEADS = {
    "ui": ROLE + "\nRULES:\n" + BELOW + UNSUPPORTED + CITE_SUPPORTED + CONCISE + "\n",
    "cli": ROLE + "\nRULES:\n" + BELOW + UNSUPPORTED + CITE_IN_ANSWER + CONCISE + "\n",
    "local": ROLE + "\nRULES:\n" + PROVIDED + UNSUPPORTED + CITE_CLAIMS + CONCISE + "\n",
    "hosted": ROLE + "\nRULES:\n" + PROVIDED + UNSUPPORTED + CITE_CLAIMS + CONCISE + "\n\n",
    "training": ROLE + "RULES:\n" + BELOW + UNSUPPORTED + CITE_IN_ANSWER + CONCISE + "\n",
}
GENERATE_HEAD = (
    "\nYou are helping create a medical RAFT dataset.\n\n"
    "You will see one ORACLE passage (contains the true answer) and 3 DISTRACTOR passages (related but irrelevant).\n\n"
    "Task:\n"
    "1. Write ONE specific medical question that can ONLY be answered from the ORACLE passage.\n"
    "2. Write one short grounded answer using only the ORACLE passage.\n\n"
    'Return JSON with keys: "question", "final_answer".\n\n'
)
QUOTES = '"""'
ORACLE_MARK, DISTRACTOR_MARK = "Context (oracle):", "Distractors:"
END = "<END_ANSWER>"


def source_blocks(sources: Column) -> Column:
    """Numbered blocks of an array of (chunk_id, pdf_name, text), with a rule between."""
    blocks = F.transform(
        sources,
        lambda s, i: F.concat(
            F.lit("[S"), (i + 1).cast("string"), F.lit("] pdf="), s["pdf_name"], F.lit(" chunk_id="), s["chunk_id"], F.lit("\n"), s["text"]
        ),
    )
    return F.array_join(blocks, RULE)


def question_prompt(kind: str, question: Column, sources: Column) -> Column:
    """kind: ui, cli, local or hosted."""
    return F.concat(
        F.lit(HEADS[kind] + "QUESTION:\n"), question, F.lit("\n\nSOURCES:\n"), source_blocks(sources), F.lit("\n")
    )


def generation_prompt(oracle: Column, distractors: Column) -> Column:
    """One passage and three others, asking for a question and its answer as JSON."""
    quoted = F.transform(
        F.slice(distractors, 1, 3),
        lambda d, i: F.concat((i + 1).cast("string"), F.lit(f")\n{QUOTES}"), d, F.lit(f"{QUOTES}\n")),
    )
    return F.concat(
        F.lit(f"{GENERATE_HEAD}ORACLE:\n{QUOTES}"), oracle, F.lit(f"{QUOTES}\n\nDISTRACTORS:\n"), F.array_join(quoted, "\n")
    )


def raft_input(oracle: Column, distractors: Column) -> Column:
    return F.concat(F.lit(ORACLE_MARK + "\n"), oracle, F.lit(f"\n\n{DISTRACTOR_MARK}\n"), F.array_join(distractors, RULE))


def raft_split(text: Column) -> tuple[Column, Column]:
    """The oracle and the distractors of a record's input; without the second mark all of it is oracle."""
    whole = strip(text)
    first = F.when(F.contains(whole, F.lit(DISTRACTOR_MARK)), before(whole, DISTRACTOR_MARK)).otherwise(whole)
    parts = F.split(after(whole, DISTRACTOR_MARK), rf"\Q{RULE}\E", -1)
    return (
        strip(F.replace(first, F.lit(ORACLE_MARK), F.lit(""))),
        F.filter(F.transform(parts, strip), lambda p: p != ""),
    )


def training_text(question: Column, record_input: Column, answer: Column) -> Column:
    """One text for supervised training: prompt, cited answer, end marker. At most three distractors."""
    oracle, others = raft_split(record_input)
    others = F.transform(
        F.slice(others, 1, 3),
        lambda d, i: F.struct(
            F.concat(F.lit("distractor_chunk_"), (i + 1).cast("string")).alias("chunk_id"), F.lit("distractor_doc").alias("pdf_name"), d.alias("text")
        ),
    )
    first = F.struct(F.lit("oracle_chunk").alias("chunk_id"), F.lit("oracle_doc").alias("pdf_name"), oracle.alias("text"))
    return F.concat(
        F.lit(HEADS["training"] + "QUESTION:\n"),
        strip(question),
        F.lit("\n\nSOURCES:\n"),
        source_blocks(F.concat(F.array(first), others)),
        F.lit("\n\nANSWER:\n"),
        cited(answer),
        F.lit("\n" + END),
    )
