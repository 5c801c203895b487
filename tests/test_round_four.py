"""Findings of round four."""

from __future__ import annotations

import json
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from postweave.operators import documents as D
from postweave.plans import all_queries  # noqa: F401
from postweave.plans.document_queries import BASES
from postweave.plans.registry import QUERIES

TEXT = 'first "line" é\nmiddle [RELEVANT_SKILLS]\nlast line'
DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


def posting(n, title, company, skills):
    """The posting that the fixture makes of document ``n``."""
    pairs = {"job_title": f"Role {n}", "organization": f"Org {n % 17}", "level": "en", "job_summary": TEXT, "required_skills": skills, "notes": TEXT}
    return {
        "id": str(n), "title": title, "company": company, "division": "src", "openings": str(n % 9), "city": f"City {n % 23}",
        "level": "en", "deadline": "2025-01-31", "details": [{"key": k, "value": v} for k, v in pairs.items()],
        "status_tags": ["en", "src"], "error": None,
    }


def test_prompts_hold_the_whole_posting_and_replies_are_whole(spark, tmp_path):
    """F3. Before, a prompt held five fields of the posting and a reply was a digest of 45 characters."""
    rows = [(n, TEXT, "en", "src", len(TEXT)) for n in (1, 3, 13, 35)]
    spark.createDataFrame([*rows, (2, None, "en", "src", None)], DOCUMENT).write.parquet(str(tmp_path / "documents.parquet"))
    found = {(r.id, r.kind): r.reply for r in QUERIES["batch_generate"](spark, str(tmp_path)).collect()}
    assert len(found) == 10
    shown = {
        1: (posting(1, TEXT, "src", TEXT), TEXT, "src", TEXT),
        3: (posting(3, TEXT, "src", "N/A"), TEXT, "src", "N/A"),
        35: (posting(35, "", None, TEXT), "Role 35", "Org 1", TEXT),
    }
    failed = posting(13, TEXT, "src", "") | {"status_tags": None, "error": "Timeout 60000ms exceeded"}
    failed["details"] = [{"key": "error", "value": failed["error"]}]
    shown[13] = (failed, TEXT, "src", "")
    for n, (record, title, company, skills) in shown.items():
        for kind, word in D.KIND_WORDS.items():
            values = zip(D.PLACEHOLDERS, (title, company, f"of City {n % 23}", skills))
            reply = BASES[kind]
            for placeholder, value in values:
                reply = reply.replace(placeholder, value)
            job = json.dumps(record, ensure_ascii=False, separators=(",", ":"))
            prompt = D.PROMPT_HEAD.format(kind=word) + job + D.PROMPT_MIDDLE + BASES[kind] + D.PROMPT_TAIL
            assert found[str(n), kind] == f"{reply}\n% {md5(prompt.encode()).hexdigest()} 0 4000"
    assert found["2", "resume"].startswith("\\documentclass{article}\nRole 2 at src\n\\end{document}\n% ")


def test_long_replies_leave_in_pieces(spark, monkeypatch):
    """F3. Pieces keep the order and the absent replies, and a wrong number of replies still fails."""
    monkeypatch.setattr(D, "REPLIES_TOGETHER", 50, raising=False)
    prompts = spark.range(100).select("id", F.when(F.col("id") % 10 != 3, F.concat(F.lit("p"), "id")).alias("prompt")).coalesce(1)

    def echo(some, temperature, max_tokens):
        assert len(some) <= 7
        return [p and p * 9 for p in some]

    found = {r.id: r.reply for r in D.generate_replies(prompts, echo, batch_size=7).collect()}
    assert found == {n: None if n % 10 == 3 else f"p{n}" * 9 for n in range(100)}
    for wrong in (lambda some, *_: some[1:], lambda some, *_: [*some, "x"]):
        with pytest.raises(Exception):
            D.generate_replies(prompts, wrong).collect()
    assert D.generate_replies(prompts.limit(0), echo).collect() == []


def test_a_round_keeps_whole_titles_and_skills(spark, tmp_path):
    """F4. As ``test_titles_and_skills_are_whole_texts`` has it for other queries: no line or short column in place of the text."""
    spark.createDataFrame([(1, TEXT, "en", "src", len(TEXT)), (39, TEXT, "en", "src", len(TEXT))], DOCUMENT).write.parquet(str(tmp_path / "documents.parquet"))
    parts = [(n, f"part {n}", "Brand#1", "STEEL", 7, 1.0) for n in (1, 2, 3, 4, 39)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(str(tmp_path / "part.parquet"))
    found = sorted(QUERIES["collect_round"](spark, str(tmp_path)).collect(), key=lambda r: r.seq)
    assert [(r.seq, r.id) for r in found] == [(1, "1"), (39, "39"), (40, "2"), (41, "39")]  # 39 had failed; 3 and 4 are no list rows
    details = ["job_title=Role 1", "organization=Org 1", "level=en", *(f"{k}={TEXT}" for k in ("job_summary", "required_skills", "notes"))]
    assert found[0].title == TEXT and found[0].details.split("\x01") == details
    assert found[1].error == "Timeout 60000ms exceeded" and found[2].error == "No detail page" and found[3].error is None
