"""Whole-table text jobs on edges: signatures, code, token windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.functions.signatures import canonical_signature, collapse_blanks, let, stub_code, struct_signature, token_pair, words_and_signs

#: Pseudo methods and spellings in raw edges.
REGISTER_FINALIZE = "register-finalize"
BOOT_CALLERS = ("com/ibm/wala/FakeRootClass.fakeRootMethod:()V", "com/ibm/wala/FakeRootClass.fakeWorldClinit:()V")
BOOT_TARGET = "com/ibm/wala/FakeRootClass.fakeWorldClinit:()V"
LAMBDA_FACTORY = "java/lang/invoke/LambdaMetafactory."
ARRAY_COPY = "com/ibm/wala/model/java/lang/System.arraycopy:(Ljava/lang/Object;Ljava/lang/Object;)V"
JAVA_ARRAY_COPY = "java/lang/System.arraycopy:(Ljava/lang/Object;ILjava/lang/Object;II)V"
LAMBDA = r"^wala/lambda\$(.+)\$([^$.:]+)\.([^.:]+).*$"


def _line_parts(value: str) -> Column:
    """Struct of a raw line's ``caller``, ``index`` and ``target``, and the ``reason`` why it can't be an edge (null if it can)."""
    return let(F.split(F.regexp_replace(value, r"^\s+|\s+$", ""), "\t"), lambda fields: let(F.get(fields, F.lit(1)), lambda site: _field_parts(F.col(value), fields, site)))


def _field_parts(value: Column, fields: Column, site: Column) -> Column:
    last = F.substring_index(site, "/", -1)
    front = F.substring(site, F.lit(1), F.length(site) - F.length(last) - 1)
    given = F.struct(F.regexp_extract(front, r"^.([^)]*\)[^>]*)>", 1).alias("caller"), last.alias("index"))

    def parts(p: Column) -> Column:
        caller, index = p["caller"], p["index"]
        reason = F.when(value.isNull() | (F.size(fields) != 4), "fields").when(~site.contains("/") | (caller == ""), "call site").when(caller.startswith(REGISTER_FINALIZE), REGISTER_FINALIZE)
        reason = reason.when(~F.regexp_like(index, F.lit("^[0-9]+$")), "index")
        return F.struct(caller.alias("caller"), index.alias("index"), F.get(fields, F.lit(3)).alias("target"), reason.alias("reason"))

    return let(given, parts)


def parse_text_edges(lines: DataFrame, value: str = "value") -> DataFrame:
    """Edges from tab-separated lines (context, ``<signature>/callee/index``, context, ``<signature>``), unreadable lines dropped.

    A line is dropped unless it has four fields, the call site has a slash, a closing
    parenthesis and a bracket after it, its index is digits, and it isn't a
    register-finalize entry. The index becomes the offset. ``rejected_lines`` has the rest.
    """
    target = lambda p: F.regexp_replace(p["target"], "^[<>]+|[<>]+$", "")
    edge = lambda p: F.struct(canonical_signature(p["caller"]).alias("method"), p["index"].cast("long").alias("offset"), canonical_signature(target(p)).alias("target"))
    made = let(_line_parts(value), lambda p: F.when(p["reason"].isNull(), edge(p)))
    # exploded rather than filtered: a filter would compute all of it a second time
    return lines.select(F.explode(F.filter(F.array(made), lambda e: e.isNotNull())).alias("_e")).select("_e.method", "_e.offset", "_e.target")


def rejected_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """The lines that ``parse_text_edges`` drops, with the ``reason``: fields, call site, register-finalize or index."""
    own = F.filter(F.array(_line_parts(value)["reason"]), lambda r: r.isNotNull())
    return lines.select("*", F.explode(own).alias("reason"))


def flatten_callsite_json(methods: DataFrame) -> DataFrame:
    """One edge per method, call site and target from ``reachableMethods``; duplicates stay."""
    method = methods.select(F.explode("reachableMethods").alias("m"))
    site = method.select(struct_signature(F.col("m.method")).alias("method"), F.explode("m.callSites").alias("s"))
    return site.select("method", F.col("s.pc").cast("long").alias("offset"), F.explode("s.targets").alias("t")).select("method", "offset", struct_signature(F.col("t")).alias("target"))


def _canonical_name(name: Column) -> Column:
    """A lambda class as a member of its owner, the modelled array copy as the library's."""
    part = lambda i: F.regexp_extract(name, LAMBDA, i)
    lifted = F.concat(F.translate(part(1), "$", "/"), F.lit(".<lambda/"), part(3), F.lit("$"), part(2), F.lit(">:()V"))
    return F.when(F.regexp_like(name, F.lit(LAMBDA)), lifted).when(name == ARRAY_COPY, F.lit(JAVA_ARRAY_COPY)).otherwise(name)


def normalize_edges(edges: DataFrame) -> DataFrame:
    """Canonical names: lambda classes and the array copy renamed, boot callers as ``<boot>`` at offset 0.

    Edges into the boot initialiser and those from or to the lambda factory are dropped.
    """
    out = edges.filter((F.col("target") != BOOT_TARGET) & ~F.col("method").startswith(LAMBDA_FACTORY) & ~F.col("target").startswith(LAMBDA_FACTORY))
    boot = F.col("method").isin(*BOOT_CALLERS)
    method = F.when(boot, F.lit("<boot>")).otherwise(_canonical_name(F.col("method")))
    return out.withColumns({"offset": F.when(boot, F.lit(0)).otherwise(F.col("offset")).cast("long"), "method": method, "target": _canonical_name(F.col("target"))})


def normalize_raw(raw: DataFrame, dialect: str) -> tuple[DataFrame, DataFrame]:
    """Edges under canonical names from any raw form, and the rows that give none, with a ``reason``.

    ``dialect``: "text" (lines in a column ``value``), "callsites" (``reachableMethods``
    as JSON gives them) or "edges" (method, offset, target already).
    """
    if dialect == "text":
        return normalize_edges(parse_text_edges(raw)), rejected_lines(raw)
    if dialect not in ("callsites", "edges"):
        raise ValueError(f"no dialect {dialect}")
    edges = flatten_callsite_json(raw) if dialect == "callsites" else raw
    missing = F.when(F.col("method").isNull(), "method").when(F.col("offset").isNull(), "offset").when(F.col("target").isNull(), "target")
    return normalize_edges(edges.filter(missing.isNull())), edges.select("*", missing.alias("reason")).filter("reason is not null")


def edge_text(edges: DataFrame, code: DataFrame, keys: Sequence[str], signature: str = "signature", text: str = "code") -> DataFrame:
    """``method_code`` and ``target_code`` of every edge: its known code, else a stub made from the signature, else the signature.

    Each distinct signature is looked up once, then joined to both ends.
    """
    names = edges.select(F.col("method").alias("_s")).unionByName(edges.select(F.col("target").alias("_s"))).distinct()
    known = code.select(F.col(signature).alias("_k"), collapse_blanks(F.col(text)).alias("_c")).filter("_c is not null")
    known = known.groupBy("_k").agg(F.min("_c").alias("_c"))
    found = names.join(known, F.col("_s") == F.col("_k"), "left").select("_s", F.coalesce("_c", stub_code(F.col("_s")), "_s").alias("_c"))
    out = edges.select(*keys)
    for side in ("method", "target"):
        out = out.join(found.select(F.col("_s").alias(side), F.col("_c").alias(f"{side}_code")), side, "left")
    return out.select(*keys, "method_code", "target_code")


def token_windows(texts: DataFrame, keys: Sequence[str], most: int = 512) -> DataFrame:
    """``tokens`` and ``mask`` of every edge, made once per distinct pair of method and target."""
    pair = texts.select("method", "target", "method_code", "target_code").dropDuplicates(["method", "target"])
    made = pair.select("method", "target", token_pair(words_and_signs(F.col("method_code")), words_and_signs(F.col("target_code")), most).alias("w"))
    return texts.select(*keys).join(made, ["method", "target"]).select(*keys, "w.tokens", "w.mask")
