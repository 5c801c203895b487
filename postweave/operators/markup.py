"""HTML pages to rows. Everything happens inside one row per page: no shuffle, no Python.

Markup is taken as a browser serialises it (closed elements, quoted attributes). Tokens are
``struct<raw, tag, pos>`` where ``tag`` is the lower-case name, ``/name`` for a closing tag and
``''`` for text, and ``pos`` counts from 1 over the page; detail pages add the ``text`` of text
tokens. Helpers that start with ``_`` compose SQL text; operators map DataFrames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postweave.functions.text import (
    decode_entities_sql,
    lambda_sql,
    let_sql,
    literal,
    normalize_key_sql,
    strip,
    strip_sql,
)

# Class names, row layout, detail keys and the url part of the direct layout.
ROW_CLASS = "table__row--body"
HEADER_CLASS = "dashboard-header--mini"
COMPANY_CLASS = "font--14"
TAG_RAIL_CLASS = "tag-rail"
TAG_CLASS = "tag-label"
SECTION_CLASS = "tag__key-value-list"
LABEL_CLASS = "label"
DIRECT_LAYOUT_URL = "/myAccount/co-op/direct/jobs.htm"
MIN_CELLS = 8
CELL_FIELDS = ["company", "division", "openings", "city", "level", "deadline"]  # cells 2 to 7
NOT_AVAILABLE = "N/A"
VOID_TAGS = [
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr",
]

# The rest of a tag: a quoted value, which follows "=", may hold ">". Possessive, so that a tag with
# any number of attributes is read without going back or deep.
_REST = r"""[^>=]*+(?:=\s*+(?:"[^"]*"|'[^']*')?+[^>=]*+)*+>"""
_HIDDEN = rf"(?is)<script\b{_REST}.*?</script\s*>|<style\b{_REST}.*?</style\s*>|<!--.*?-->"
_TOKEN = rf"</?[a-zA-Z!]{_REST}|[^<]+|<"
_BODY = rf"(?is)<tbody\b{_REST}(.*?)</tbody\s*>"
_CELL = rf"(?is)<td\b{_REST}(.*?)(?:</td\s*>|(?=<t[dh]\b)|$)"
_HEAD_CELL = rf"(?is)<th\b{_REST}(.*?)(?:</th\s*>|(?=<t[dh]\b)|$)"
_LINK = rf"(?is)<a\b{_REST}(.*?)</a\s*>"
_BLOCKS = (
    "address|article|aside|blockquote|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|"
    "pre|section|table|tr|ul"
)


def _class_pattern(name: str) -> str:
    return rf"""\bclass\s*=\s*["'](?:[^"']*\s)?{name}(?:\s[^"']*)?["']"""


# The row's own class attribute: the quoted values before it are passed over whole.
_ROW_CLASS_PATTERN = _class_pattern(ROW_CLASS)
_ROW_START = (
    rf"""<tr\b(?=(?:(?!{_ROW_CLASS_PATTERN})(?:=\s*+(?:"[^"]*"|'[^']*')?+|[^>=]))*+{_ROW_CLASS_PATTERN})"""
)
_ROW = rf"(?is){_ROW_START}{_REST}(.*?)</tr\s*>"


def _all(text: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({text}, {literal(pattern)}, {group})"


def _visible(html: str) -> str:
    return f"regexp_replace({html}, {literal(_HIDDEN)}, '')"


def _tokens(html: str) -> str:
    tag = r"if(startswith(t, '<'), lower(regexp_extract(t, '^<(/?[a-zA-Z][a-zA-Z0-9]*)', 1)), '')"
    token = f"named_struct('raw', t, 'tag', {tag}, 'pos', i + 1)"
    return f"transform({_all(_visible(html), _TOKEN)}, (t, i) -> {token})"


def _with_texts(tokens: str) -> str:
    """Tokens with ``text``: the stripped text of a text token, else empty."""
    text = strip_sql(decode_entities_sql("t.raw"))
    is_text = "t.tag = '' and not startswith(t.raw, '<!')"
    token = f"named_struct('raw', t.raw, 'tag', t.tag, 'pos', t.pos, 'text', if({is_text}, {text}, ''))"
    return f"transform({tokens}, t -> {token})"


def _place(tokens: str, pos: str) -> str:
    """Where a page position lies in a slice of the tokens."""
    return f"({pos} - get({tokens}, 0).pos + 1)"


def rendered_text_sql(markup: str) -> str:
    """Approximate on-screen text: collapse white space, ``<br>`` to newline, no tags, stripped.

    Blocks stand on lines of their own, paragraphs with a blank line around them.
    """

    def flat(m: str) -> str:
        return rf"regexp_replace({m}, '[ \\t\\r\\n\\f]+', ' ')"

    def replaced(m: str, pattern: str, by: str) -> str:
        return f"regexp_replace({m}, {literal(pattern)}, {literal(by)})"

    def tagless(m: str) -> str:
        lines = replaced(flat(_visible(m)), rf"(?i) ?<br\b{_REST} ?", "\n")
        blocks = replaced(replaced(lines, rf"(?i)</?p\b{_REST}", "\x02"), rf"(?i)</?(?:{_BLOCKS})\b{_REST}", "\x01")
        plain = replaced(blocks, rf"</?[a-zA-Z!]{_REST}", "")
        # the widest break of neighbouring blocks counts, once
        broken = replaced(replaced(plain, "[\x01 ]*\x02[\x01\x02 ]*", "\n\n"), "[ ]*\x01[\x01 ]*", "\n")
        return f"if(contains({m}, '<'), {broken}, {flat(m)})"

    return strip_sql(decode_entities_sql(let_sql(markup, tagless)))


def _text_nodes(tokens: str) -> str:
    """Stripped, non-empty text nodes in order."""
    texts = lambda_sql("filter", tokens, lambda t: f"{t}.text <> ''")
    return lambda_sql("transform", texts, lambda t: f"{t}.text")


def _text(tokens: str, separator: str = "") -> str:
    return f"array_join({_text_nodes(tokens)}, {literal(separator)})"


def _close_position(tokens: str, tag: str) -> str:
    """Where the element opened by the first token is closed (the end when it is not)."""
    kind = lambda_sql("filter", tokens, lambda t: f"{t}.tag in ('{tag}', '/{tag}')")
    depth = f"(s.depth + if(t.tag = '{tag}', 1, -1))"
    at = f"case when s.at > 0 then s.at when {depth} = 0 then t.pos else 0 end"
    step = f"named_struct('depth', {depth}, 'at', {at})"
    finish = f"if(s.at > 0, {_place(tokens, 's.at')}, size({tokens}))"
    return f"aggregate({kind}, named_struct('depth', 0, 'at', 0), (s, t) -> {step}, s -> {finish})"


def _openings(tokens: str, tag: str, class_name: str | None = None) -> str:
    """Where elements of a kind are opened."""

    def wanted(t: str) -> str:
        has_class = f" and {t}.raw rlike {literal('(?i)' + _class_pattern(class_name))}" if class_name else ""
        return f"{t}.tag = '{tag}'{has_class}"

    found = lambda_sql("filter", tokens, wanted)
    return lambda_sql("transform", found, lambda t: _place(tokens, f"{t}.pos"))


def _element_at(tokens: str, tag: str, start: str) -> str:
    rest = f"slice({tokens}, {start}, size({tokens}))"
    return let_sql(rest, lambda r: f"slice({r}, 1, {_close_position(r, tag)})")


def _elements(tokens: str, tag: str, class_name: str | None = None) -> str:
    """Token arrays of all elements of a kind, nested ones included."""
    starts = _openings(tokens, tag, class_name)
    return lambda_sql("transform", starts, lambda start: _element_at(tokens, tag, start))


def _first_element(tokens: str, tag: str, class_name: str | None = None) -> str:
    """Token array of the first element of a kind, null when there is none."""
    starts = f"slice({_openings(tokens, tag, class_name)}, 1, 1)"
    found = lambda_sql("transform", starts, lambda start: _element_at(tokens, tag, start))
    return f"get({found}, 0)"


def _sibling_spans(tokens: str) -> str:
    """``spans`` of the ``p``, ``ul`` and ``div`` elements that follow at the same level, up to the
    next section or the end of the parent, and whether one of them is still ``open`` at the end."""
    void = ", ".join(literal(v) for v in VOID_TAGS)
    tags = lambda_sql(
        "filter", tokens, lambda t: f"{t}.tag <> '' and {t}.tag not in ({void}) and not endswith({t}.raw, '/>')"
    )
    closing = "startswith(t.tag, '/')"
    section = f"(t.tag = 'div' and t.raw rlike {literal('(?i)' + _class_pattern(SECTION_CLASS))})"
    zero = """named_struct('depth', 0, 'start', 0, 'block', '', 'stop', false,
                'spans', cast(array() as array<struct<start:int,end:int>>))"""
    # Inside a block only the depth changes; at depth 0 a block starts or the search stops.
    step = f"""case
      when s.stop then s
      when {closing} and s.depth = 1 then named_struct('depth', 0, 'start', 0, 'block', '', 'stop', false,
        'spans', if(s.block in ('p', 'ul', 'div'),
                    concat(s.spans, array(named_struct('start', s.start, 'end', t.pos))), s.spans))
      when s.depth > 0 then named_struct('depth', s.depth + if({closing}, -1, 1), 'start', s.start,
        'block', s.block, 'stop', false, 'spans', s.spans)
      when {closing} or {section} then named_struct('depth', 0, 'start', 0, 'block', '', 'stop', true, 'spans', s.spans)
      else named_struct('depth', 1, 'start', t.pos, 'block', t.tag, 'stop', false, 'spans', s.spans) end"""
    finish = "named_struct('spans', s.spans, 'open', s.depth > 0 and not s.stop)"
    return f"aggregate({tags}, {zero}, (s, t) -> {step}, s -> {finish})"


def _sibling_blocks(tokens: str, rest: str) -> str:
    """Token arrays of the blocks that follow a section in ``tokens``, which end at the next section.

    A block that is still open there wraps that section: then all the ``rest`` of the page is read.
    """

    def blocks(within: str, spans: str) -> str:
        return lambda_sql(
            "transform", spans, lambda x: f"slice({within}, {_place(within, f'{x}.start')}, {x}.end - {x}.start + 1)"
        )

    wrapped = let_sql(rest, lambda r: blocks(r, f"{_sibling_spans(r)}.spans"))
    return let_sql(_sibling_spans(tokens), lambda x: f"if({x}.open, {wrapped}, {blocks(tokens, f'{x}.spans')})")


_TABLE_EDGE = rf"(?is)(?=</?table\b|{_ROW_START})"
_TABLE_PART = r"(?i)<(/?)(tr|td|th|tbody)\b"


def _outer_tables(html: str) -> str:
    """The page with the rows and cells of tables inside a result row renamed, so that they end none."""
    kind = f"""case when rlike(p, '(?i)^</table') then 'end' when rlike(p, '(?i)^<table') then 'table'
      when startswith(p, '<') and rlike(p, {literal("(?is)^" + _ROW_START)}) then 'row' else '' end"""
    # depth -1: outside a result row; 0: in one; above: tables opened in it
    depth = f"""case {kind} when 'row' then greatest(s.depth, 0)
      when 'table' then if(s.depth >= 0, s.depth + 1, -1)
      when 'end' then greatest(s.depth - 1, -1) else s.depth end"""
    masked = f"if({depth} > 0, regexp_replace(p, {literal(_TABLE_PART)}, '<$1inner-$2'), p)"
    step = f"named_struct('depth', {depth}, 'parts', concat(s.parts, array({masked})))"
    zero = "named_struct('depth', -1, 'parts', cast(array() as array<string>))"

    def walked(part: str) -> str:
        pieces = f"split({part}, {literal(_TABLE_EDGE)})"
        return f"aggregate({pieces}, {zero}, (s, p) -> {step}, s -> array_join(s.parts, ''))"

    # From one result row to the next no table stays open unless its end is missing, so each such stretch stands
    # alone and only those with a table in them are walked.
    opens, ends = literal(r"(?i)<table\b"), literal(r"(?i)</table\b")
    row = literal("(?is)^" + _ROW_START)

    def of_page(page: str) -> str:
        stretches = f"split({page}, {literal('(?is)(?=' + _ROW_START + ')')})"

        def joined(parts: str) -> str:
            has_table = lambda x: f"rlike({x}, {opens}) and rlike({x}, {row})"
            closed = lambda_sql("forall", parts, lambda x: f"not ({has_table(x)}) or regexp_count({x}, {opens}) <= regexp_count({x}, {ends})")
            each = lambda_sql("transform", parts, lambda x: f"if({has_table(x)}, {walked(x)}, {x})")
            return f"if({closed}, array_join({each}, ''), {walked(page)})"

        return let_sql(stretches, joined)

    several = literal(r"(?is)<table\b.*<table\b")
    return let_sql(html, lambda page: f"if(rlike({page}, {several}), {of_page(page)}, {page})")


# ---- token table ---------------------------------------------------------------------------


def html_tokens(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Ordered token table ``(key, pos, tag, raw)``."""
    exploded = pages.select(key, F.posexplode(F.expr(_tokens(html))).alias("pos", "token"))
    return exploded.select(key, F.col("pos").cast("bigint").alias("pos"), "token.tag", "token.raw")


# ---- list pages ----------------------------------------------------------------------------


def list_rows(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row per result row of a list page with its cells (``cells``, ``heads``) as markup."""
    bodies = _all(_outer_tables(_visible(html)), _BODY, 1)
    rows = lambda_sql("transform", bodies, lambda b: _all(b, _ROW, 1))
    others = [c for c in pages.columns if c != html]
    return pages.select(
        *others, F.posexplode(F.expr(f"flatten({rows})")).alias("row_no", "row_html")
    ).select(
        *others,
        "row_no",
        F.expr(_all("row_html", _CELL, 1)).alias("cells"),
        F.expr(_all("row_html", _HEAD_CELL, 1)).alias("heads"),
    )


def enough_cells(rows: DataFrame) -> DataFrame:
    return rows.filter(F.size("cells") >= MIN_CELLS)


def has_title_link(title_cell: Column) -> Column:
    return title_cell.rlike(r"(?i)<a[\s>]")


# Row ids and title cells by layout, over ``texts`` (rendered cells), ``cells`` and ``heads`` (markup).
_FULL_ID = (
    "if(size(heads) >= 1, "
    + let_sql(
        rendered_text_sql("get(heads, 0)"),
        lambda x: f"coalesce(try_element_at(regexp_extract_all({x}, '[0-9]+', 0), -1), {x})",
    )
    + ", get(texts, 0))"
)
_FULL_TITLE = "if(size(heads) >= 1, get(cells, 0), get(cells, 1))"
_DIRECT_ID = "get(texts, 0)"
_DIRECT_TITLE = "get(cells, 1)"


def _project(rows: DataFrame, posting_id: str, title_cell: str) -> DataFrame:
    kept = [c for c in rows.columns if c not in ("cells", "heads")]
    linked = enough_cells(rows).filter(has_title_link(F.expr(title_cell)))
    texts = F.expr(lambda_sql("transform", "cells", rendered_text_sql))
    return linked.withColumn("texts", texts).select(
        *kept,
        F.expr(posting_id).alias("id"),
        F.expr(rendered_text_sql(f"regexp_extract({title_cell}, {literal(_LINK)}, 1)")).alias("title"),
        *[F.get("texts", F.lit(i)).alias(f) for i, f in enumerate(CELL_FIELDS, 2)],
    )


def list_rows_full(rows: DataFrame) -> DataFrame:
    """Full layout: with a head cell the id comes from it and the title is the first cell."""
    return _project(rows, _FULL_ID, _FULL_TITLE)


def list_rows_direct(rows: DataFrame) -> DataFrame:
    """Direct layout: id, title, then the six fields."""
    return _project(rows, _DIRECT_ID, _DIRECT_TITLE)


def list_rows_dispatch(rows: DataFrame, url: str = "url") -> DataFrame:
    """Choose the layout per page by its url in one pass; the full layout is the default."""
    direct = f"coalesce(contains({url}, {literal(DIRECT_LAYOUT_URL)}), false)"
    return _project(
        rows, f"if({direct}, {_DIRECT_ID}, {_FULL_ID})", f"if({direct}, {_DIRECT_TITLE}, {_FULL_TITLE})"
    )


# ---- detail pages --------------------------------------------------------------------------

_NO_PAIRS = "cast(array() as array<struct<key:string,value:string>>)"


def _pair(key: str, value: str) -> str:
    return f"named_struct('key', {key}, 'value', {value})"


def _header_pairs(tokens: str) -> str:
    """Title (``N/A`` without ``h2``); organisation and division only with two spans or more."""

    def of_header(h: str) -> str:
        title = f"coalesce({_text(_first_element(h, 'h2'))}, '{NOT_AVAILABLE}')"

        def of_spans(spans: str) -> str:
            organization = _pair("'organization'", _text(f"get({spans}, 0)"))
            division = _pair("'division'", _text(f"get({spans}, 1)"))
            return f"if(size({spans}) >= 2, array({organization}, {division}), {_NO_PAIRS})"

        spans = let_sql(_first_element(h, "div", COMPANY_CLASS), lambda c: _elements(c, "span"))
        title_pair = _pair("'job_title'", title)
        return f"if({h} is null, {_NO_PAIRS}, concat(array({title_pair}), {let_sql(spans, of_spans)}))"

    return let_sql(_first_element(tokens, "div", HEADER_CLASS), of_header)


def _status_tags(tokens: str) -> str:
    rail = _first_element(tokens, "div", TAG_RAIL_CLASS)
    labels = let_sql(rail, lambda r: lambda_sql("transform", _elements(r, "span", TAG_CLASS), _text))
    return f"coalesce({labels}, cast(array() as array<string>))"


def _first_part(key: str, paragraph: str) -> str:
    def joined(tag: str, separator: str, keep_empty: bool) -> str:
        texts = lambda_sql("transform", _elements(paragraph, tag), _text)
        if not keep_empty:
            texts = lambda_sql("filter", texts, lambda x: f"{x} <> ''")
        return let_sql(
            texts, lambda x: f"if(size({x}) > 0, array_join({x}, {literal(separator)}), '{NOT_AVAILABLE}')"
        )

    return f"""case when {paragraph} is null then ''
      when {key} = 'level' then {joined("td", ", ", True)}
      when {key} = 'targeted_degrees_and_disciplines' then {joined("li", chr(10), True)}
      when {key} = 'additional_information' then {joined("td", chr(10), False)}
      else {_text(paragraph, chr(10))} end"""


def _sections(tokens: str) -> str:
    """Sections in page order as ``struct<key, first_part, later_parts>``; key null without a label."""

    def cut(starts: str) -> str:
        following = f"coalesce(get({starts}, i + 1), size({tokens}) + 1)"
        section = f"slice({tokens}, start, {following} - start)"
        return f"transform({starts}, (start, i) -> named_struct('start', start, 'tokens', {section}))"

    def halves(section: str) -> str:
        return let_sql(
            _close_position(f"{section}.tokens", "div"),
            lambda at: f"""named_struct('inside', slice({section}.tokens, 1, {at}), 'next', {section}.start + {at},
              'after', slice({section}.tokens, {at} + 1, size({section}.tokens)))""",
        )

    def parts(half: str) -> str:
        label = _first_element(f"{half}.inside", "span", LABEL_CLASS)
        rest = f"slice({tokens}, {half}.next, size({tokens}))"
        return f"""named_struct('key', {normalize_key_sql(_text(label))},
          'p', {_first_element(f"{half}.inside", "p")}, 'blocks', {_sibling_blocks(f"{half}.after", rest)})"""

    def texts(x: str) -> str:
        later = lambda_sql("transform", f"{x}.blocks", lambda b: _text(b, "\n"))
        return f"""named_struct('key', {x}.key, 'first_part', {_first_part(f"{x}.key", f"{x}.p")},
          'later_parts', {later})"""

    # One step per transform, so that each is evaluated once per section.
    sections = let_sql(_openings(tokens, "div", SECTION_CLASS), cut)
    for step in (halves, parts, texts):
        sections = lambda_sql("transform", sections, step)
    return sections


def _section_value(section: str) -> str:
    """Non-blank parts joined by a blank line, ``N/A`` when there are none."""
    parts = lambda_sql(
        "filter",
        f"concat(array({section}.first_part), {section}.later_parts)",
        lambda x: f"{strip_sql(x)} <> ''",
    )
    return let_sql(parts, lambda p: f"if(size({p}) > 0, array_join({p}, '\n\n'), '{NOT_AVAILABLE}')")


def merge_pairs_sql(pairs: str) -> str:
    """A repeated key keeps its first position and takes its last value."""
    keys = f"array_distinct({lambda_sql('transform', pairs, lambda p: f'{p}.key')})"

    def last(k: str) -> str:
        return f"element_at({lambda_sql('filter', pairs, lambda p: f'{p}.key = {k}')}, -1).value"

    return lambda_sql("transform", keys, lambda k: _pair(k, last(k)))


def _with_tokens(pages: DataFrame, html: str) -> DataFrame:
    others = [c for c in pages.columns if c != html]
    return pages.select(
        *others,
        F.expr(f"if({html} is null, 'Empty detail page', null)").alias("error"),
        F.expr(_with_texts(_tokens(html))).alias("tokens"),
    )


def detail_headers(pages: DataFrame, html: str = "html") -> DataFrame:
    """Add ``header``: the pairs read from the page header (an empty array without one)."""
    others = [c for c in pages.columns if c != html]
    return _with_tokens(pages, html).select(*others, F.expr(_header_pairs("tokens")).alias("header"))


def detail_tags(pages: DataFrame, html: str = "html") -> DataFrame:
    """Add ``status_tags``: the tag labels (an empty array without any)."""
    others = [c for c in pages.columns if c != html]
    return _with_tokens(pages, html).select(*others, F.expr(_status_tags("tokens")).alias("status_tags"))


def detail_sections(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """One row per labelled section: ``(key, section_no, section, first_part, n_later, value)``."""
    rows = _with_tokens(pages, html).select(
        key, F.posexplode(F.expr(_sections("tokens"))).alias("section_no", "s")
    )
    return rows.filter(F.col("s.key").isNotNull()).select(
        key,
        F.col("section_no").cast("bigint").alias("section_no"),
        F.col("s.key").alias("section"),
        F.col("s.first_part").alias("first_part"),
        F.size("s.later_parts").cast("bigint").alias("n_later"),
        F.expr(_section_value("s")).alias("value"),
    )


def detail_records(pages: DataFrame, html: str = "html") -> DataFrame:
    """Replace the page by ``details`` (ordered pairs), ``status_tags`` and ``error``.

    A page that could not be read (null) is an error; a blank one is a record without details.
    """
    others = [c for c in pages.columns if c != html]
    kept = lambda_sql("filter", _sections("tokens"), lambda s: f"{s}.key is not null and {s}.key <> 'job_title'")
    section_pairs = lambda_sql("transform", kept, lambda s: _pair(f"{s}.key", _section_value(s)))
    pairs = f"concat({_header_pairs('tokens')}, {section_pairs})"
    parsed = _with_tokens(pages, html).select(
        *others, "error", F.expr(_status_tags("tokens")).alias("tags"), F.expr(pairs).alias("pairs")
    )
    return parsed.select(
        *others,
        F.expr(f"if(error is null, {merge_pairs_sql('pairs')}, null)").alias("details"),
        F.expr("if(error is null, tags, null)").alias("status_tags"),
        "error",
    )


def strip_fields(df: DataFrame, *fields: str) -> DataFrame:
    return df.withColumns({f: strip(F.col(f)) for f in fields})


def split_quarantine(rows: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """Good rows without the error column, and the rows that carry an error."""
    return rows.filter(F.col(error).isNull()).drop(error), rows.filter(F.col(error).isNotNull())
