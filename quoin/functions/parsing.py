"""Column functions that read free-form model outputs. Nothing is dropped: each output gives values and a valid flag."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, label_key, let, strip_ws


def first_json_object(text: Column) -> Column:
    """The first JSON object that begins at some brace, as a variant; what follows it is ignored. Null if there is none."""
    start = F.struct(F.lit(1).alias("at"), F.lit(None).cast("variant").alias("found"))

    def further(s: Column, part: Column) -> Column:  # ``at`` is the place of the brace before the part
        at = s["at"] + F.length(part) + 1
        tried = F.when(s["found"].isNull(), let(F.try_parse_json(F.substring(text, s["at"] - 1, F.length(text))), lambda v: F.when(F.schema_of_variant(v).startswith("OBJECT"), v)))
        return F.struct(at.alias("at"), F.coalesce(s["found"], F.when(s["at"] > 1, tried)).alias("found"))

    return F.aggregate(F.split(text, r"\{"), start, further)["found"]


def parse_qa(output: Column) -> Column:
    """struct<present boolean, evidence array<string>, valid boolean> of a question-answering output."""
    none = F.array().cast("array<string>")

    def values(r: Column) -> Column:
        found = r["found"]
        return F.struct(r["text"].alias("text"), F.try_variant_get(found, "$.present", "variant").alias("present"), F.try_variant_get(found, "$.evidence", "variant").alias("evidence"))

    def read(r: Column) -> Column:
        kind = F.schema_of_variant(r["evidence"])
        strict = F.coalesce(F.schema_of_variant(r["present"]) == "BOOLEAN", F.lit(False))
        listed = F.coalesce(F.try_variant_get(r["evidence"], "$", "array<string>"), none)
        quotes = F.when(kind == "STRING", F.array(F.try_variant_get(r["evidence"], "$", "string"))).when(kind == "ARRAY<STRING>", listed).otherwise(none)
        # a list that mixes strings and nulls has the type of its strings
        whole = F.coalesce(~F.exists(listed, lambda q: q.isNull()), F.lit(True))
        ok = r["evidence"].isNull() | (kind == "VOID") | (kind == "ARRAY<VOID>") & (F.size(listed) == 0) | (kind == "ARRAY<STRING>") & whole
        quotes = F.filter(F.transform(F.when(whole, quotes).otherwise(none), strip_ws), lambda q: F.length(q) > 0)
        said = F.try_variant_get(r["present"], "$", "boolean")
        word = F.lower(F.regexp_extract(r["text"], r'(?i)"present"[' + WS + r"]*:[" + WS + r"]*(true|false)", 1))
        recovered = F.when(word == "true", True).when(word == "false", False)
        return F.struct(
            F.when(strict, said).otherwise(recovered).alias("present"),
            F.when(strict & said, quotes).otherwise(none).alias("evidence"),
            F.coalesce(strict & ok, F.lit(False)).alias("valid"),
        )

    text = F.regexp_replace(strip_ws(output), rf"(?i)^```(?:json)?[{WS}]*|(?<![{WS}])[{WS}]*```\z", "")
    # each step's value is worked out once a row, however often the next one names it
    return let(let(let(text, lambda t: F.struct(t.alias("text"), first_json_object(t).alias("found"))), values), read)


def parse_label(output: Column, labels: list[str]) -> Column:
    """struct<label string, valid boolean>: the label that the cleaned output is, else the longest that it holds."""
    # fixed values: the prefixes of a label
    clean = F.regexp_replace(strip_ws(output), rf"(?i)^(clause type|answer|label)[{WS}]*:[{WS}]*", "")
    clean = strip_ws(F.btrim(strip_ws(clean), F.lit("\"'`*.")))
    known = {" ".join(x.split()).casefold(): x for x in labels}
    rows = [F.struct(F.lit(k).alias("key"), F.lit(v).alias("label"), F.lit(i).alias("i")) for i, (k, v) in enumerate(known.items())]
    table = F.array(*rows) if rows else F.array().cast("array<struct<key:string,label:string,i:int>>")
    exact = F.get(F.filter(table, lambda r: r["key"] == label_key(clean)), 0)
    held = F.filter(table, lambda r: F.contains(label_key(output), r["key"]))
    longest = F.get(F.array_sort(held, lambda a, b: F.when(F.length(a["label"]) != F.length(b["label"]), F.length(b["label"]) - F.length(a["label"])).otherwise(a["i"] - b["i"])), 0)
    return F.struct(F.coalesce(exact["label"], longest["label"]).alias("label"), exact.isNotNull().alias("valid"))
