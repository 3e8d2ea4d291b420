"""Contracts of model output: what fields an answer has, of which types, and what is wrong with one.

A contract is a dict of fields; ``problems`` compiles it to an expression over the
answers' raw text, which Spark evaluates for a whole table, and ``found`` checks
one parsed answer within a task, where a client is asked again. Both give the
same paths and reasons in the same order.

Fields that a contract doesn't name are allowed. An answer that isn't JSON, is
null, empty, followed by other text or names a field twice is ``$: not JSON``; one that isn't an object is
``$: not an object``. Null is no text and no list, also where a field may be missing.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Text:
    required: bool = True


@dataclass(frozen=True)
class Texts:
    """A list of texts with ``least`` elements or more."""

    required: bool = True
    least: int = 0


#: The fields of a scene's narrative as models must give them.
NARRATIVE = {"narrative_paragraph": Text(), "key_moments": Texts(least=1), "mentioned_entities": Texts(required=False), "mentioned_events": Texts(required=False)}

PROBLEM = "array<struct<path:string,reason:string>>"


def _problem(path: Column, reason: str) -> Column:
    return F.struct(path.alias("path"), F.lit(reason).alias("reason"))


def _kind(v: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def _field(answer: Column, name: str, field: Text | Texts) -> Column:
    """The problems of one field of an object."""
    value = F.try_variant_get(answer, f"$.{name}", "variant")
    one = lambda reason: F.array(_problem(F.lit(name), reason)).cast(PROBLEM)
    none = F.array().cast(PROBLEM)
    missing = F.when(value.isNull(), one("missing") if field.required else none)
    if isinstance(field, Text):
        return missing.when(_kind(value) != "STRING", one("not a text")).otherwise(none)
    listed = F.try_variant_get(answer, f"$.{name}", "array<variant>")
    wrong = lambda x, i: F.when(x.isNull() | (_kind(x) != "STRING"), _problem(F.concat(F.lit(f"{name}["), i.cast("string"), F.lit("]")), "not a text"))
    elements = F.array_compact(F.transform(listed, wrong)).cast(PROBLEM)
    return missing.when(_kind(value) != "ARRAY", one("not a list")).when(F.size(listed) < field.least, one(f"fewer than {field.least}")).otherwise(elements)


def problems(answer: Column, contract: dict[str, Text | Texts]) -> Column:
    """All problems of an answer's text as (path, reason), in the order of the contract's fields; empty if it keeps the contract."""
    # The parser ignores what follows a value, so the answer stands within an object that must end as it should.
    mark = F.sha2(answer, 256)
    framed = F.try_parse_json(F.concat(F.lit('{"answer":'), answer, F.lit(',"end":"'), mark, F.lit('"}')))
    v = F.when(F.try_variant_get(framed, "$.end", "string") == mark, F.try_variant_get(framed, "$.answer", "variant"))
    whole = lambda reason: F.array(_problem(F.lit("$"), reason)).cast(PROBLEM)
    fields = reduce(F.concat, (_field(v, name, field) for name, field in contract.items()))
    return F.when(v.isNull(), whole("not JSON")).when(_kind(v) != "OBJECT", whole("not an object")).otherwise(fields)


def told(found: Column) -> Column:
    """Problems as one text, 'path: reason' joined by '; '; null if there are none."""
    return F.nullif(F.array_join(F.transform(found, lambda p: F.concat(p["path"], F.lit(": "), p["reason"])), "; "), F.lit(""))


def found(answer: object, contract: dict[str, Text | Texts]) -> list[tuple[str, str]]:
    """``problems`` of one parsed answer."""
    if not isinstance(answer, dict):
        return [("$", "not an object")]
    out = []
    for name, field in contract.items():
        if name not in answer:
            out += [(name, "missing")] * field.required
        elif isinstance(field, Text):
            out += [(name, "not a text")] * (not isinstance(answer[name], str))
        elif not isinstance(answer[name], list):
            out.append((name, "not a list"))
        elif len(answer[name]) < field.least:
            out.append((name, f"fewer than {field.least}"))
        else:
            out += [(f"{name}[{i}]", "not a text") for i, x in enumerate(answer[name]) if not isinstance(x, str)]
    return out
