"""Which document goes with which posting, and what to do with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postweave.operators.documents import KINDS
from postweave.operators.joins import even_join

# Fixed values.
RESUME_NAME = "Resume + "
COVER_NAME = "Cover letter + "


def upload_manifest(postings: DataFrame, present: DataFrame) -> DataFrame:
    """``resume_path`` and ``cover_path`` per posting, null where no file exists.

    ``present``: ``(job_id, kind, path)``; both kinds are folded into one row before one join.
    """
    path = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("path")))
    folded = present.groupBy("job_id").agg(
        path(KINDS[0]).alias("resume_path"), path(KINDS[1]).alias("cover_path")
    )
    return even_join(postings, folded, "job_id")


def no_directory(postings: DataFrame) -> DataFrame:
    """The manifest when no directory is given."""
    nothing = F.lit(None).cast("string")
    return postings.withColumns({"resume_path": nothing, "cover_path": nothing})


def document_names(job_id: Column) -> dict[str, Column]:
    return {
        "resume_name": F.concat(F.lit(RESUME_NAME), job_id),
        "cover_name": F.concat(F.lit(COVER_NAME), job_id),
    }


def upload_actions(manifest: DataFrame) -> DataFrame:
    """``application``: cancel on pre-screening, else submit; per kind upload, skip or none.

    Reads ``prescreening, resume_slot, cover_slot`` next to the two paths. A skipped upload does
    not stop the submission.
    """

    def action(slot: str, path: str) -> Column:
        return (
            F.when(F.col("prescreening"), "none")
            .when(~F.coalesce(slot, F.lit(False)), "none")
            .when(F.col(path).isNotNull(), "upload")
            .otherwise("skip")
        )

    return manifest.withColumns(
        {
            "application": F.when(F.col("prescreening"), "cancel").otherwise("submit"),
            "resume_action": action("resume_slot", "resume_path"),
            "cover_action": action("cover_slot", "cover_path"),
        }
    )
