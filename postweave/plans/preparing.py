"""Whole plans after matching: selected postings to documents, and documents to an upload plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postweave.operators import documents as D
from postweave.operators import manifest
from postweave.operators.flatten import company_or_detail, detail, title_or_detail
from postweave.sources import generated

def base_template(bases: dict[str, str]) -> Column:
    """The base template of the row's ``kind``."""
    first, second = D.KINDS
    return F.when(F.col("kind") == first, bases[first]).otherwise(bases[second])


def template_values() -> dict[str, Column]:
    """What the offline generator puts in for the placeholders, from the posting itself."""
    skills = detail(F.col("details"), "required_skills")
    return {
        "job_title": title_or_detail(),
        "company_name": company_or_detail(),
        "company_reason": detail(F.col("details"), "job_summary"),
        "relevant_skills": skills,
    }


def prepare_documents(
    selection: DataFrame,
    postings: DataFrame,
    order: list[str],
    bases: dict[str, str],
    out_dir: str,
    generator: D.Generator | None = None,
) -> DataFrame:
    """``rank, job_id, kind, prompt, reply, body, path, pdf`` for each selected posting and kind.

    The reply is cleaned; an empty one gives the base template.
    """
    chosen = D.lookup_selected(D.selected_ids(selection), postings, order).withColumn("id", F.col("job_id"))
    base = base_template(bases)
    others = "other_details" if "other_details" in chosen.columns else None
    prompts = D.build_prompts(chosen, D.posting_json(others), base)
    replies = D.generate_replies(prompts, generator, D.fill_template(base, template_values()))
    documents = replies.withColumn("body", D.or_base(D.extract_block(F.col("reply")), base))
    placed = documents.withColumn("path", D.tex_path(out_dir, F.col("job_id"), F.col("kind")))
    return placed.withColumn("pdf", D.pdf_path(F.col("path"))).select(
        "rank", "job_id", "kind", "prompt", "reply", "body", "path", "pdf"
    )


def write_documents(prepared: DataFrame, out_dir: str) -> DataFrame:
    """Write each document once, however often its posting is selected; ``(job_id, kind, path)``."""
    return generated.write_generated(prepared.dropDuplicates(["job_id", "kind"]), out_dir)


def plan_uploads(spark: SparkSession, postings: DataFrame, out_dir: str | None, extension: str = ".pdf") -> DataFrame:
    """Manifest of ``postings (job_id, prescreening, resume_slot, cover_slot)`` with names and actions."""
    if out_dir is None:
        placed = manifest.no_directory(postings)
    else:
        placed = manifest.upload_manifest(postings, generated.present_generated(postings, out_dir, extension))
    return manifest.upload_actions(placed).withColumns(manifest.document_names(F.col("job_id")))
