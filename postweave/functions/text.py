"""String functions that keep the truthiness and whitespace rules of the source records.

Functions on Columns serve flat expressions. The ``*_sql`` forms return SQL text: nested lambdas
are far cheaper to build as one parsed expression than as thousands of Column calls.
"""

from __future__ import annotations

from html.entities import name2codepoint
from itertools import count

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters removed by a full whitespace strip.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

_ENTITY_PIECES = r"&#[0-9]{1,7};|&#[xX][0-9a-fA-F]{1,6};|&[a-zA-Z][a-zA-Z0-9]*;|[^&]+|&"
_names = count()


# ---- Columns -------------------------------------------------------------------------------


def strip(text: Column) -> Column:
    """Remove every kind of whitespace at both ends (``trim`` removes spaces only)."""
    return F.btrim(text, F.lit(WHITESPACE))


def or_else(first: Column, *rest: Column) -> Column:
    """First value that is neither null nor empty, else the last one as it is."""
    values = [first, *rest]
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values[:-1]], values[-1])


def is_truthy(text: Column) -> Column:
    return text.isNotNull() & (text != "")


def last_number(text: Column) -> Column:
    """Last run of digits, else the stripped text."""
    runs = F.regexp_extract_all(text, F.lit(r"[0-9]+"), F.lit(0))
    return F.coalesce(F.try_element_at(runs, F.lit(-1)), strip(text))


def normalize_key(label: Column) -> Column:
    """``Work/Term:`` to ``work_term``: drop colons, lower case, space and slash to underscore."""
    return F.translate(F.lower(strip(label)), " /:", "__")


def escape_html(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


# ---- SQL text ------------------------------------------------------------------------------


def literal(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def lambda_sql(function: str, array: str, body) -> str:
    """``function(array, x -> body(x))`` with a name for ``x`` that no other lambda uses."""
    x = f"x{next(_names)}"
    return f"{function}({array}, {x} -> {body(x)})"


def let_sql(value: str, body) -> str:
    """Evaluate ``value`` once and hand its name to ``body``."""
    return f"get({lambda_sql('transform', f'array({value})', body)}, 0)"


def strip_sql(text: str) -> str:
    return f"btrim({text}, {literal(WHITESPACE)})"


def normalize_key_sql(label: str) -> str:
    return f"translate(lower({strip_sql(label)}), ' /:', '__')"


def json_string_sql(text: str) -> str:
    """A JSON string in ASCII: the short escapes, all else outside ``space`` to ``~`` as ``\\uXXXX``."""
    for char, escape in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        text = f"replace({text}, {literal(char)}, {literal(escape)})"

    def escaped(piece: str) -> str:
        units = f"lower(hex(encode({piece}, 'UTF-16BE')))"
        codes = lambda_sql("transform", f"regexp_extract_all({units}, '.{{4}}', 0)", lambda u: f"concat('\\\\u', {u})")
        return f"if({piece} rlike '^[ -~]', {piece}, array_join({codes}, ''))"

    pieces = lambda_sql("transform", f"regexp_extract_all({text}, '[ -~]+|[^ -~]', 0)", escaped)
    return f"concat('\"', array_join({pieces}, ''), '\"')"


def _code_point_sql(number: str) -> str:
    known = f"if(cast({number} as bigint) between 1 and 1114111, cast({number} as bigint), 65533)"
    return f"decode(unhex(lpad(hex({known}), 8, '0')), 'UTF-32')"


def decode_entities_sql(text: str) -> str:
    """Named (HTML 4) and numeric character references to characters, each decoded once."""
    listed = "\x01".join(f"&{name};\x02{chr(cp)}" for name, cp in name2codepoint.items())
    names = f"str_to_map({literal(listed)}, '\x01', '\x02')"  # folded to one literal

    def one(piece: str) -> str:
        decimal = f"regexp_extract({piece}, '([0-9]+)', 1)"
        hexadecimal = f"conv(regexp_extract({piece}, '[xX]([0-9a-fA-F]+)', 1), 16, 10)"
        return f"""case when not startswith({piece}, '&') then {piece}
          when {piece} rlike '^&#[0-9]' then {_code_point_sql(decimal)}
          when {piece} rlike '^&#[xX]' then {_code_point_sql(hexadecimal)}
          else coalesce(try_element_at({names}, {piece}), {piece}) end"""

    def decoded(raw: str) -> str:
        pieces = f"regexp_extract_all({raw}, {literal(_ENTITY_PIECES)}, 0)"
        return f"if(contains({raw}, '&'), array_join({lambda_sql('transform', pieces, one)}, ''), {raw})"

    return let_sql(text, decoded)
