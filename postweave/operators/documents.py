"""Selected postings to prompts, replies, documents and paths."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postweave.functions.text import json_string_sql, lambda_sql, let_sql, or_else, strip
from postweave.operators.collect import last_wins
from postweave.operators.flatten import company_or_detail, title_or_detail
from postweave.operators.joins import even_join, thinned_keys

# Posting fields, kinds, prompt text, reply patterns, placeholders, file names and display defaults.
FLAT_FIELDS = ["id", "title", "company", "division", "openings", "city", "level", "deadline"]
KINDS = ["resume", "cover_letter"]
KIND_WORDS = {"resume": "resume", "cover_letter": "cover letter"}
PROMPT_HEAD = (
    "Generate a complete LaTeX {kind} for this job. Use the base template style but personalize for "
    "this specific role:\n\nJob: "
)
PROMPT_MIDDLE = (
    "\n\nBase template (copy this structure verbatim, including preamble, packages, fonts, margins, "
    "macros, and formatting; only change textual content):\n"
)
PROMPT_TAIL = (
    "\n\nReturn ONLY the complete LaTeX code starting with \\documentclass and ending with "
    "\\end{document}. Do not include markdown or explanations."
)
FENCED_BLOCK = r"(?s)```(?:latex|tex)?\s*\n(.*?)\n```"
WHOLE_DOCUMENT = r"(?s)\\documentclass.*?\\end\{document\}"
PLACEHOLDERS = {
    "[JOB_TITLE]": "job_title",
    "[COMPANY_NAME]": "company_name",
    "[COMPANY_REASON]": "company_reason",
    "[RELEVANT_SKILLS]": "relevant_skills",
}
NO_TITLE = "(No title)"
NO_COMPANY = "(No company)"
MAX_TOKENS = 4000
TEMPERATURE = 0
REPLIES_TOGETHER = 1 << 20  # characters of replies that leave a generator's task together

Generator = Callable[[list[str], float, int], list[str]]  # prompts, temperature, token limit


# ---- selection and look-up -----------------------------------------------------------------


def selected_ids(matches: DataFrame) -> DataFrame:
    return matches.select("job_id", "rank")


def _latest_selected(selection: DataFrame, postings: DataFrame, order: list[str]) -> DataFrame:
    """Last version of the postings that are selected; the others leave before any sorting."""
    wanted = postings.withColumnRenamed("id", "job_id").join(thinned_keys(selection, "job_id"), "job_id", "left_semi")
    return last_wins(wanted, "job_id", order)


def lookup_selected(selection: DataFrame, postings: DataFrame, order: list[str]) -> DataFrame:
    """Selected postings, last version each; unknown ids drop out, repeats of the selection stay."""
    return even_join(selection, _latest_selected(selection, postings, order), "job_id", "inner")


def lookup_for_display(selection: DataFrame, postings: DataFrame, order: list[str]) -> DataFrame:
    """``job_id, rank, title, company`` with nulls for unknown ids."""
    latest = _latest_selected(selection, postings, order).select(
        "job_id", title_or_detail().alias("title"), company_or_detail().alias("company")
    )
    return even_join(selection, latest, "job_id", "left")


def display_defaults(rows: DataFrame) -> DataFrame:
    return rows.withColumns(
        {
            "title": or_else(F.col("title"), F.lit(NO_TITLE)),
            "company": or_else(F.col("company"), F.lit(NO_COMPANY)),
        }
    )


def application_count(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("applications"))


# ---- prompts and replies -------------------------------------------------------------------


def record_json(columns: list[str]) -> Column:
    """A record as compact JSON, nulls kept."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def posting_json(others: str | None = None) -> Column:
    """A posting as JSON indented by two, ASCII only, details in page order (tags after the header).

    ``others`` names a column of details that are no strings (JSON by key): they come last, each on one line.
    """

    def member(name: str, value: str, depth: int) -> str:
        return f"concat('{' ' * depth}', {name}, ': ', {value})"

    def block(lines: str, depth: int, ends: str) -> str:
        joined = f"concat('{ends[0]}\n', array_join({lines}, ',\n'), '\n{' ' * depth}{ends[1]}')"
        return f"if(size({lines}) = 0, '{ends}', {joined})"

    def nullable(text: str) -> str:
        return f"coalesce({json_string_sql(text)}, 'null')"

    tag_lines = lambda_sql("transform", "status_tags", lambda t: f"concat('      ', {json_string_sql(t)})")
    tags = f"if(status_tags is null, array(), array({member(_quoted('status_tags'), block(tag_lines, 4, '[]'), 4)}))"
    pairs = lambda_sql(
        "transform", "details", lambda d: member(json_string_sql(f"{d}.key"), nullable(f"{d}.value"), 4)
    )
    heads = lambda_sql("filter", "details", lambda d: f"{d}.key in ('job_title', 'organization')")
    header = f"size({heads}) + if(size({heads}) = 2 and get(details, 2).key = 'division', 1, 0)"
    rest = f"slice({pairs}, 1 + {header}, size(details))"
    if others is not None:
        entries = f"coalesce(map_entries({others}), array())"
        rest += ", " + lambda_sql("transform", entries, lambda o: member(json_string_sql(f"{o}.key"), f"{o}.value", 4))
    lines = f"concat(slice({pairs}, 1, {header}), {tags}, {rest})"
    details = f"coalesce({let_sql(lines, lambda x: block(x, 2, '{}'))}, 'null')"
    flat = [member(_quoted(f), nullable(f), 2) for f in FLAT_FIELDS]
    members = ", ".join([*flat, member(_quoted("details"), details, 2)])
    return F.expr(f"concat('{{\n', array_join(array({members}), ',\n'), '\n}}')")


def _quoted(name: str) -> str:
    return f"'\"{name}\"'"


def with_kinds(rows: DataFrame) -> DataFrame:
    """One row per document kind."""
    return rows.withColumn("kind", F.explode(F.array(*[F.lit(k) for k in KINDS])))


def build_prompts(postings: DataFrame, record: Column, base: Column) -> DataFrame:
    """``kind`` and ``prompt`` per posting and kind. ``base`` may depend on ``kind``."""
    heads = {k: PROMPT_HEAD.format(kind=w) for k, w in KIND_WORDS.items()}
    head = F.when(F.col("kind") == KINDS[0], heads[KINDS[0]]).otherwise(heads[KINDS[1]])
    prompt = F.concat(head, record, F.lit(PROMPT_MIDDLE), base, F.lit(PROMPT_TAIL))
    return with_kinds(postings).withColumn("prompt", prompt)


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    """Replace each placeholder by its value (an absent value by nothing)."""
    for placeholder, name in PLACEHOLDERS.items():
        template = F.replace(template, F.lit(placeholder), F.coalesce(values[name], F.lit("")))
    return template


def generate_replies(
    prompts: DataFrame,
    generator: Generator | None = None,
    offline: Column | None = None,
    batch_size: int = 16,
    temperature: float = TEMPERATURE,
    max_tokens: int = MAX_TOKENS,
) -> DataFrame:
    """Add ``reply``: the generator on batches of prompts, one stream per task.

    Without a generator the ``offline`` expression (a filled template) stands in for the model.
    """
    if generator is None:
        return prompts.withColumn("reply", offline)

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            replies, held = [], 0
            for i in range(0, len(batch), batch_size):  # prompts and replies are long: few are strings at a time
                some = list(generator(batch.slice(i, batch_size).to_pylist(), temperature, max_tokens))
                replies += some
                held += sum(len(r or "") for r in some)
                if held > REPLIES_TOGETHER:
                    yield pa.array(replies, pa.string())
                    replies, held = [], 0
            yield pa.array(replies, pa.string())

    # Called non-deterministic so that the optimizer never runs the model twice for a prompt.
    return prompts.withColumn("reply", run.asNondeterministic()(F.col("prompt")))


def extract_block(reply: Column) -> Column:
    """The first fenced block, else the document from class to end, else the stripped reply."""
    text = F.coalesce(reply, F.lit(""))
    return (
        F.when(text.rlike(FENCED_BLOCK), strip(F.regexp_extract(text, FENCED_BLOCK, 1)))
        .when(text.rlike(WHOLE_DOCUMENT), strip(F.regexp_extract(text, WHOLE_DOCUMENT, 0)))
        .otherwise(strip(text))
    )


def is_complete(body: Column) -> Column:
    """Whether the document was not cut off before its end."""
    return F.contains(body, F.lit(r"\end{document}"))


def or_base(body: Column, base: Column) -> Column:
    return or_else(body, base)


# ---- paths ---------------------------------------------------------------------------------


def tex_path(out_dir: str, job_id: Column, kind: Column) -> Column:
    return F.concat(F.lit(out_dir.rstrip("/") + "/"), job_id, F.lit("_"), kind, F.lit(".tex"))


def pdf_path(path: Column) -> Column:
    """The path with its extension replaced by ``.pdf`` (a leading dot is no extension)."""
    return F.concat(F.regexp_replace(path, r"([^/.][^/]*)\.[^./]*$", "$1"), F.lit(".pdf"))


def flatten_outputs(rows: DataFrame, *paths: str) -> DataFrame:
    """One row per output path, in the order given."""
    others = [c for c in rows.columns if c not in paths]
    return rows.select(*others, F.posexplode(F.array(*paths)).alias("output_no", "path"))


def with_suffix(paths: DataFrame, path: str, suffix: str = ".pdf") -> DataFrame:
    return paths.filter(F.lower(path).endswith(suffix))
