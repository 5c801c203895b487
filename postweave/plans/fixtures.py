"""Tables derived from the given tables: postings, portal pages, logs, requests and replies.

Each rule is scalar SQL over one source row (list pages group a bounded run of rows), so the
derived tables grow with their source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postweave.functions.text import escape_html
from postweave.operators.markup import DIRECT_LAYOUT_URL
from postweave.plans.registry import table
from postweave.session import spread

ROWS_PER_PAGE = 50


def jobs(
    spark: SparkSession, sf_dir: str, title: str = "concat(lang, ' role at ', source)", skills: str = "concat(lang, ', ', source)"
) -> DataFrame:
    """Postings from ``documents``, with empty, missing, long and failed records among them.

    Title and skills come from short columns, summary and notes are the whole text.
    """
    return spread(table(spark, sf_dir, "documents")).selectExpr(
        "doc_id as seq",
        "cast(doc_id as string) as id",
        f"case when doc_id % 7 = 0 then '' when doc_id % 11 = 0 then null else {title} end as title",
        "case when doc_id % 5 = 0 then null else source end as company",
        "source as division",
        "cast(doc_id % 9 as string) as openings",
        "concat('City ', cast(doc_id % 23 as string)) as city",
        "lang as level",
        "'2025-01-31' as deadline",
        f"""case when doc_id % 13 = 0
             then array(named_struct('key', 'error', 'value', 'Timeout 60000ms exceeded'))
             else array(
               named_struct('key', 'job_title', 'value', concat('Role ', cast(doc_id as string))),
               named_struct('key', 'organization', 'value', concat('Org ', cast(doc_id % 17 as string))),
               named_struct('key', 'level', 'value', lang),
               named_struct('key', 'job_summary', 'value', text),
               named_struct('key', 'required_skills', 'value',
                 case when doc_id % 3 = 0 then 'N/A' when doc_id % 4 = 0 then ''
                      else {skills} end),
               named_struct('key', 'notes', 'value', text)) end as details""",
        "case when doc_id % 13 = 0 then cast(null as array<string>) else array(lang, source) end as status_tags",
        "case when doc_id % 13 = 0 then 'Timeout 60000ms exceeded' end as error",
    )


# The same postings for DuckDB; used as the head of a WITH list.
JOBS_SQL = """
jobs AS (
  SELECT doc_id AS seq, CAST(doc_id AS VARCHAR) AS id,
    CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 11 = 0 THEN NULL ELSE lang || ' role at ' || source END AS title,
    CASE WHEN doc_id % 5 = 0 THEN NULL ELSE source END AS company,
    source AS division, CAST(doc_id % 9 AS VARCHAR) AS openings,
    'City ' || CAST(doc_id % 23 AS VARCHAR) AS city, lang AS level, '2025-01-31' AS deadline,
    CASE WHEN doc_id % 13 = 0 THEN 'Timeout 60000ms exceeded' END AS error,
    CASE WHEN doc_id % 13 <> 0 THEN 'Role ' || CAST(doc_id AS VARCHAR) END AS d_job_title,
    CASE WHEN doc_id % 13 <> 0 THEN 'Org ' || CAST(doc_id % 17 AS VARCHAR) END AS d_organization,
    CASE WHEN doc_id % 13 <> 0 THEN lang END AS d_level,
    CASE WHEN doc_id % 13 <> 0 THEN text END AS d_job_summary,
    CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN 'N/A' WHEN doc_id % 4 = 0 THEN ''
         ELSE lang || ', ' || source END AS d_required_skills,
    CASE WHEN doc_id % 13 <> 0 THEN text END AS d_notes
  FROM documents)"""


def whole_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same postings, but title and skills are the whole text as well."""
    return jobs(spark, sf_dir, title="text", skills="text")


WHOLE_JOBS_SQL = JOBS_SQL.replace("lang || ' role at ' || source", "text").replace("lang || ', ' || source", "text")


def part_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List pages in the full layout: 50 rows of ``part`` per page, five kinds of row.

    Some cells hold a block, some a table of their own, and attributes hold ``>``.
    """
    rows = table(spark, sf_dir, "part").selectExpr(
        "p_partkey",
        f"p_partkey div {ROWS_PER_PAGE} as page_id",
        "p_partkey % 10 as kind",
        "concat('<td><a title=\"a > b\" href=\"#\">', p_name, '</a></td>') as linked",
        "concat('<td> ', p_brand, if(p_partkey % 3 = 0, '<div>West </div>', ''), '\\n</td><td>', p_type, "
        "if(p_partkey % 4 = 0, '<table><tr><td>in</td></tr></table>', ''), '</td><td>', p_size, '</td>') as middle",
    )
    tail = "<td>city</td><td>level</td>"
    html = F.expr(
        f"""concat('<tr data-x="1 > 0" class="table__row--body even">',
          case when kind = 5 then concat('<td> ', p_partkey, ' </td>', linked)
               when kind = 6 then concat('<th> none </th>', linked, '<td></td>')
               when kind = 4 then concat('<th><input> ', p_partkey, '</th><td>', p_partkey, '</td><td></td>')
               else concat('<th><input> Job 7 id ', p_partkey, '</th>', linked, '<td></td>') end,
          middle, '{tail}', case when kind = 3 then '' else '<td>deadline</td>' end, '</tr>')"""
    )
    return _list_pages(rows.select("page_id", F.col("p_partkey").alias("k"), html.alias("row")), "/full/jobs.htm")


def supplier_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List pages in the direct layout from ``supplier``; one row in ten has no link."""
    rows = table(spark, sf_dir, "supplier").selectExpr(
        f"s_suppkey div {ROWS_PER_PAGE} as page_id",
        "s_suppkey as k",
        """concat('<tr class="table__row--body"><td>', s_suppkey, '</td><td>',
             case when s_suppkey % 10 = 4 then s_name else concat('<a title=\\'">\\' href="#">', s_name, ' &amp; Co</a>') end,
             '</td><td>Company ', s_nationkey, '</td><td></td><td>', s_nationkey,
             '</td><td>city</td><td>level</td><td>deadline</td></tr>') as row""",
    )
    return _list_pages(rows, DIRECT_LAYOUT_URL)


def _list_pages(rows: DataFrame, path: str) -> DataFrame:
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "row"))), lambda x: x.row), "\n")
    start = '<html><body><table><thead><tr class="head"><th>Id</th></tr></thead><tbody>'
    pages = rows.groupBy("page_id").agg(body.alias("body")).select(
        "page_id",
        F.concat(F.lit(f"https://portal.example{path}?page="), F.col("page_id")).alias("url"),
        F.concat(F.lit(start), "body", F.lit("</tbody></table></body></html>")).alias("html"),
    )
    # pages are small and parsing them is not: dealt out as the files of a page table would be
    return pages.repartition(rows.sparkSession.sparkContext.defaultParallelism)


def detail_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detail pages from ``documents``; by ``doc_id % 6`` some headers and tag rails are missing.

    A few pages are blank, and as many could not be read (null).
    """
    docs = spread(table(spark, sf_dir, "documents"))
    text = escape_html(F.col("text"))

    def section(label: str, inside: str, after: str = "", css: str = "tag__key-value-list"):
        return f"""'<div class="{css}"><span class="label">{label}</span>', {inside}, '</div>'{after}"""

    body = ", ".join(
        [
            section("Level:", "'<p><table><tr><td>', lang, '</td><td> Senior </td><td></td></tr></table></p>'"),
            section(
                "Job Summary:",
                "'<p>', body, '</p>'",
                ", '<p>Source <b> ', source, ' </b> end</p>text <ul><li>one</li><li> two &amp; three</li></ul>'"
                ", '<table><tr><td>left out</td></tr></table>'",
                "js--open tag__key-value-list wide",
            ),
            section("Work Term:", "'<p> </p>'"),
            section("Job Title:", "'<p>ignored</p>'"),
            "'<div class=\"tag__key-value-list\"><p>no label</p></div>'",
            section(
                "Targeted Degrees and Disciplines:",
                "case when doc_id % 4 = 0 then '<p></p>'"
                " else concat('<p><ul><li>', lang, '</li><li></li><li>D ', doc_id, '</li></ul></p>') end",
            ),
            section(
                "Additional Information:",
                "concat('<p><table><tr><td>', source, '</td><td> </td><td>Row<br>', doc_id, '</td></tr></table></p>')",
            ),
            section("Contact/Web Site :", "''", ", '<div>a<div>b</div><p>c</p></div>'"),
            section("Division:", "concat('<p>Second ', doc_id % 19, '</p>')"),
        ]
    )
    header = """case kind when 1 then ''
      when 2 then '<div class="dashboard-header--mini"><div class="font--14"><span>Org</span> <span>Div</span></div></div>'
      when 3 then concat('<div class="dashboard-header--mini"><h2>Role ', doc_id,
                         '</h2><div class="font--14"><span>Only</span></div></div>')
      else concat('<div class="dashboard-header--mini"><h2> Role ', doc_id, '\\n</h2>',
                  '<div class="x font--14"><span>Org ', doc_id % 17, '</span> <span>Div</span></div></div>') end"""
    rail = """case kind when 4 then '' else concat('<div class="tag-rail"><span class="tag-label"> ', lang,
      '</span><span>no tag</span><span class="tag-label">', source, '\\n</span></div>') end"""
    return docs.select("doc_id", "lang", "source", text.alias("body"), (F.col("doc_id") % 6).alias("kind")).selectExpr(
        "doc_id",
        f"""case when doc_id % 82 = 81 then null when doc_id % 41 = 40 then '  ' else
            concat('<script>var t = "</div>";</script>', {header}, {rail}, '<div class="panel">', {body}, '</div>') end
            as html""",
    )
