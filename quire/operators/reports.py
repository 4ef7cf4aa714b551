"""Prompts, generated sections and HTML reports (SCL25, UDF2, JN5, PRJ15,
SCL26).

Model calls are an injected ``generator(prompts) -> answers`` run batch-wise
by ``mapInPandas``: Spark spreads the prompts over tasks (the reference used
a thread pool per report).  No network code lives here; tests inject a
deterministic stub.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quire.functions.text import html_escape, strip_think
from quire.session import checkpoint_dir

# Own neutral prompt text (not the reference's wording or examples).
INSTRUCTIONS = (
    "Summarise the extracted form fields below into one report section. "
    "A field that is present means the item applies. Follow the example's "
    "structure, length and tone; add nothing that is not in the fields.")
DEFAULT_EXAMPLE = "No example is available for this section."
SECTION_EXAMPLES = {
    "History": "The child lives with both parents and one sibling.",
    "Education": "The student attends a public school in the fourth grade.",
}
MISSING = "Missing"


def build_prompt(data: Column | str, section: Column | str,
                 examples: dict[str, str] | None = None) -> Column:
    """Instructions + the section's data + the section's example (a
    literal map; unknown sections get the default text)."""
    ex = examples if examples is not None else SECTION_EXAMPLES
    d = F.col(data) if isinstance(data, str) else data
    s = F.col(section) if isinstance(section, str) else section
    table = F.create_map(*[x for k, v in ex.items() for x in (F.lit(k), F.lit(v))]) if ex else None
    example = F.coalesce(F.try_element_at(table, s), F.lit(DEFAULT_EXAMPLE)) if table is not None \
        else F.lit(DEFAULT_EXAMPLE)
    return F.concat(F.lit(INSTRUCTIONS), F.lit("\n\nFields:\n"), d,
                    F.lit("\n\nExample:\n```\n"), example, F.lit("\n```"))


def build_file_prompt(text: Column | str, file: Column | str, schema_json: str) -> Column:
    """Per-document prompt asking for a JSON answer matching ``schema_json``."""
    t = F.col(text) if isinstance(text, str) else text
    f = F.col(file) if isinstance(file, str) else file
    return F.concat(F.lit("Group the recommendations of "), f,
                    F.lit(" into themes and answer with JSON matching this schema:\n```json\n"),
                    F.lit(schema_json), F.lit("\n```\n\nText:\n"), t)


def generate(df: DataFrame, generator: Callable[[list[str]], list[str]],
             prompt_col: str = "prompt", pin: bool = False) -> DataFrame:
    """Adds ``answer`` and ``error``; ``<think>`` spans are removed.

    The batch is tried at once; if that fails, rows are retried one by one
    so one bad prompt marks only its own row (``error`` = message).  A real
    model is not deterministic and costs money per call: ``pin=True``
    checkpoints the answers into the shared checkpoint folder, so a lost
    executor or a second use of the frame never calls the model again.
    """
    schema = StructType(list(df.schema.fields) + [StructField("answer", StringType()),
                                                   StructField("error", StringType())])

    def run(batches):
        for pdf in batches:
            prompts = pdf[prompt_col].tolist()
            try:
                answers, errors = list(generator(prompts)), [None] * len(prompts)
            except Exception:
                answers, errors = [], []
                for p in prompts:
                    try:
                        answers.append(generator([p])[0])
                        errors.append(None)
                    except Exception as e:  # isolate the failing prompt
                        answers.append(None)
                        errors.append(str(e))
            pdf["answer"] = pd.Series(answers, index=pdf.index, dtype=object)
            pdf["error"] = pd.Series(errors, index=pdf.index, dtype=object)
            yield pdf

    out = df.mapInPandas(run, schema)
    if pin:
        checkpoint_dir(df.sparkSession)
        out = out.checkpoint()
    return out.withColumn("answer", strip_think("answer"))


def collect_sections(requested: DataFrame, answers: DataFrame, key_cols: Sequence[str]) -> DataFrame:
    """JN5: every requested ``(key..., section, pos)`` with its text; an
    absent answer is ``Missing``, a failed one ``Error: <message>``."""
    a = answers.select(*key_cols, "section", "answer", "error")
    j = requested.join(a, [*key_cols, "section"], "left")
    text = (F.when(F.col("error").isNotNull(), F.concat(F.lit("Error: "), F.col("error")))
            .when(F.col("answer").isNotNull(), F.col("answer"))
            .otherwise(F.lit(MISSING)))
    return j.select(*key_cols, "section", "pos", text.alias("text"))


def order_sections(sections: DataFrame, order: Sequence[str], lead: str | None = None) -> DataFrame:
    """PRJ15: keep sections in ``[lead] + order``; empty ones are skipped;
    ``section_id`` keeps the position in that full order."""
    full = ([lead] if lead else []) + [s for s in order]
    pos = F.create_map(*[x for i, s in enumerate(full) for x in (F.lit(s), F.lit(i))])
    s = sections.withColumn("section_id", F.try_element_at(pos, F.col("section")))
    return s.where(F.col("section_id").isNotNull() & F.col("text").isNotNull() & (F.col("text") != ""))


def render_report(sections: DataFrame, header: DataFrame, key_col: str) -> DataFrame:
    """SCL26: one HTML document per key: header table, navigation list, a
    block per section in ``section_id`` order.  Values are escaped."""
    blocks = sections.groupBy(key_col).agg(
        F.array_sort(F.collect_list(F.struct("section_id", "section", "text"))).alias("_s"))
    nav = F.array_join(F.transform("_s", lambda x: F.format_string(
        '<li><a href="#section-%d">%s</a></li>', x["section_id"], html_escape(x["section"]))), "")
    body = F.array_join(F.transform("_s", lambda x: F.format_string(
        '<section id="section-%d"><h2>%s</h2><pre>%s</pre></section>',
        x["section_id"], html_escape(x["section"]), html_escape(x["text"]))), "")
    h = header.select(key_col, html_escape(F.col("name")).alias("_name"),
                      html_escape(F.col("date_of_birth")).alias("_dob"),
                      html_escape(F.col("dates_of_service")).alias("_dos"),
                      html_escape(F.col("age_at_evaluation")).alias("_age"))
    j = blocks.join(h, key_col, "left")
    table = F.format_string(
        "<table><tr><th>Name</th><td>%s</td></tr><tr><th>Date of birth</th><td>%s</td></tr>"
        "<tr><th>Dates of service</th><td>%s</td></tr><tr><th>Age</th><td>%s</td></tr></table>",
        F.coalesce("_name", F.lit("Unknown")), F.coalesce("_dob", F.lit("N/A")),
        F.coalesce("_dos", F.lit("N/A")), F.coalesce("_age", F.lit("Unknown")))
    html = F.concat(F.lit("<!DOCTYPE html><html><head><meta charset=\"UTF-8\"><title>Report</title>"
                          "</head><body>"), table, F.lit("<nav><ul>"), nav, F.lit("</ul></nav>"),
                    body, F.lit("</body></html>"))
    return j.select(key_col, html.alias("html"))
