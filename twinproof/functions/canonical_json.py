"""JSON text with sorted keys, as exported audit documents were hashed, in Spark expressions.

A document is cut into tokens, which are folded with a stack: a closing bracket joins
the members of its object or list into one text and hands it to the one around it.
Members of objects are sorted by the code points of their keys. Numbers are kept as
they are written; strings are written with only ASCII characters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r'"(?:[^"\\]|\\.)*"|[{}\[\],:]|[^\s"{}\[\],:]+'
PLAIN_OR_ONE = r'(?s)[ !#-\[\]-~]+|.'
# Characters with a short escape.
SHORT = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def ascii_string(text: Column) -> Column:
    """A JSON string literal of printable ASCII characters; null for null."""

    def unit(code: Column) -> Column:
        return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(code)), 4, "0"))

    def escaped(piece: Column) -> Column:
        code = F.ascii(piece)
        above = code - 0x10000
        pair = F.concat(unit(F.shiftright(above, 10) + 0xD800), unit(above.bitwiseAND(0x3FF) + 0xDC00))
        out = F.when(piece.rlike(r'^[ !#-\[\]-~]'), piece)
        for c, short in SHORT.items():
            out = out.when(piece == c, F.lit(short))
        return out.when(code > 0xFFFF, pair).otherwise(unit(code))

    pieces = F.transform(F.regexp_extract_all(text, F.lit(PLAIN_OR_ONE), F.lit(0)), escaped)
    return F.concat(F.lit('"'), F.array_join(pieces, ""), F.lit('"'))


def unquoted(token: Column) -> Column:
    """The text of a JSON string literal."""
    return F.from_json(F.concat(F.lit("["), token, F.lit("]")), "array<string>")[0]


_MEMBER = "struct<key:string,text:string,value:string>"
_FRAME = f"struct<kind:string,key:string,members:array<{_MEMBER}>>"
_STATE = f"struct<stack:array<{_FRAME}>,last:string>"


def sorted_text(document: Column) -> Column:
    """The document with sorted keys, a space behind commas and colons, and ASCII strings.

    Null for null, and for text whose brackets do not match. Keys of an object are taken
    to be different.
    """
    tokens = F.regexp_extract_all(document, F.lit(TOKEN), F.lit(0))
    nothing = F.lit(None).cast("string")
    start = F.struct(F.array().cast(f"array<{_FRAME}>").alias("stack"), nothing.alias("last"))

    def step(state: Column, token: Column) -> Column:
        stack, last = state["stack"], state["last"]
        top, rest = F.try_element_at(stack, F.lit(1)), F.slice(stack, 2, F.greatest(F.size(stack) - 1, F.lit(0)))

        def frame(kind, key, members) -> Column:
            return F.struct(kind.alias("kind"), key.alias("key"), members.alias("members"))

        def after(frames: Column, text: Column) -> Column:
            return F.struct(frames.alias("stack"), text.alias("last")).cast(_STATE)

        member = F.struct(unquoted(top["key"]).alias("key"), top["key"].alias("text"), last.alias("value"))
        members = F.when(last.isNull(), top["members"]).otherwise(F.concat(top["members"], F.array(member)))
        opened = F.concat(F.array(frame(token, nothing, F.array().cast(f"array<{_MEMBER}>"))), stack)
        keyed = F.concat(F.array(frame(top["kind"], last, top["members"])), rest)
        added = F.concat(F.array(frame(top["kind"], nothing, members)), rest)
        listed = F.concat(F.lit("["), F.array_join(F.transform(members, lambda m: m["value"]), ", "), F.lit("]"))
        pairs = F.transform(F.array_sort(members), lambda m: F.concat(m["text"], F.lit(": "), m["value"]))
        joined = F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))
        text = F.when(token.startswith('"'), ascii_string(unquoted(token))).otherwise(token)
        return (
            F.when(token.isin("{", "["), after(opened, nothing))
            .when(token == ":", after(keyed, nothing))
            .when(token == ",", after(added, nothing))
            .when((token == "]") & (top["kind"] == "["), after(rest, listed))
            .when((token == "}") & (top["kind"] == "{"), after(rest, joined))
            .when(token.isin("]", "}"), after(stack, nothing))  # does not match: the stack stays
            .otherwise(after(stack, text))
        )

    return F.aggregate(tokens, start.cast(_STATE), step, lambda s: F.when(F.size(s["stack"]) == 0, s["last"]))


def sorted_object(fields: dict[str, Column]) -> Column:
    """An object text out of finished value texts; a missing value is null."""
    members = [F.concat(F.lit(f'"{k}": '), F.coalesce(fields[k], F.lit("null"))) for k in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(", ", *members), F.lit("}"))
