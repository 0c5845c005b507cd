"""Method signatures and texts of edges, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Primitive type names and their descriptors.
PRIMITIVES = {"void": "V", "boolean": "Z", "byte": "B", "char": "C", "short": "S", "int": "I", "long": "J", "float": "F", "double": "D"}
_CODES = {code: name for name, code in PRIMITIVES.items()}


def _literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def type_descriptor(name: Column) -> Column:
    """``int[]`` to ``[I``, ``a.B`` to ``La/B;``."""
    plain = F.trim(F.regexp_replace(name, r"\[\]", ""))
    arrays = F.repeat(F.lit("["), F.regexp_count(name, F.lit(r"\[\]")))
    return F.concat(arrays, F.coalesce(_literal_map(PRIMITIVES)[plain], F.concat(F.lit("L"), F.translate(plain, ".", "/"), F.lit(";"))))


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def canonical_signature(source: Column) -> Column:
    """``a.B: int m(a.C,long)`` to ``a/B.m:(La/C;J)I``; text of another form is returned as it is.

    The class stands before the first colon. After it come the return type, any blanks,
    the name, and right behind the name the parameters up to the last parenthesis. A name
    consists of ASCII letters, digits, ``_``, ``$`` and the brackets of ``<init>``.
    """
    return let(source, _canonical)


def _canonical(source: Column) -> Column:
    owner, rest = F.substring_index(source, ":", 1), _stripped(F.substring(source, F.instr(source, ":") + 1, F.length(source)))
    return F.when(source.contains(":"), let(rest, lambda r: let(F.split(F.substring_index(r, "(", 1), r"\s+"), lambda words: _formed(source, owner, r, words)))).otherwise(source)


def _formed(source: Column, owner: Column, rest: Column, words: Column) -> Column:
    returns, name = F.get(words, F.lit(0)), F.get(words, F.lit(1))
    after = F.substring(rest, F.instr(rest, "(") + 1, F.length(rest))
    inside = F.substring(after, F.lit(1), F.length(after) - F.length(F.substring_index(after, ")", -1)) - 1)
    given = let(inside, lambda t: F.when(_stripped(t) == "", F.array().cast("array<string>")).otherwise(F.split(t, ",")))
    args = F.array_join(F.transform(given, lambda t: let(_stripped(t), type_descriptor)), "")
    made = F.concat(F.translate(_stripped(owner), ".", "/"), F.lit("."), name, F.lit(":("), args, F.lit(")"), type_descriptor(returns))
    formed = rest.contains("(") & after.contains(")") & (F.size(words) == 2) & (returns != "") & F.regexp_like(name, F.lit(r"^[\w$<>]+$"))
    return F.when(formed, made).otherwise(source)


def struct_signature(method: Column) -> Column:
    """A struct (declaringClass, name, parameterTypes, returnType) of descriptors to a canonical signature."""
    owner = F.regexp_replace(F.regexp_replace(method["declaringClass"], "^L", ""), ";$", "")
    return F.concat(owner, F.lit("."), method["name"], F.lit(":("), F.array_join(method["parameterTypes"], ""), F.lit(")"), method["returnType"])


DESCRIPTOR = r"^(.*)\.([^.:]+):\((.*)\)(.+)$"
_ONE_TYPE = r"(\[*(?:L[^;]+;|[ZBCSIJFD]))"


def _short_type(descriptor: Column, cut_inner: bool) -> Column:
    """The short source name of one descriptor: last path part, arrays as ``[]``."""
    plain = F.regexp_replace(descriptor, r"^\[+", "")
    named = F.substring_index(F.regexp_replace(F.regexp_replace(plain, "^L", ""), ";$", ""), "/", -1)
    cut = F.regexp_replace(named, r"\$.*$", "") if cut_inner else F.substring_index(named, "$", -1)
    arrays = F.repeat(F.lit("[]"), F.length(descriptor) - F.length(plain))
    return F.concat(F.coalesce(_literal_map(_CODES)[plain], cut), arrays)


def stub_code(signature: Column) -> Column:
    """A stub for a method whose code isn't known: ``class C { R m ( T a0, ) { return R1; }``.

    Parameter classes lose what follows a ``$``, the return type keeps what follows it,
    and the class loses digits right after its first ``$``. Null for other texts.
    """
    part = lambda i: F.regexp_extract(signature, DESCRIPTOR, i)
    owner = F.regexp_replace(F.substring_index(part(1), "/", -1), r"^([^$]*)\$[0-9]+", "$1\\$")
    types = F.regexp_extract_all(part(3), F.lit(_ONE_TYPE), F.lit(1))
    args = F.array_join(F.transform(types, lambda t, i: F.concat(_short_type(t, True), F.lit(" a"), i.cast("string"), F.lit(", "))), "")
    returns = F.when(part(4) == "V", F.lit("void")).otherwise(_short_type(part(4), False))
    made = F.concat(F.lit("class "), owner, F.lit(" { "), returns, F.lit(" "), part(2), F.lit(" ( "), args, F.lit(") { return "), returns, F.lit("1; }"))
    return F.when(F.regexp_like(signature, F.lit(DESCRIPTOR)), made)


def collapse_blanks(code: Column) -> Column:
    """Code with each run of white space as one blank, none at the ends; null stays null, and blank code becomes null."""
    out = F.trim(F.regexp_replace(code, r"\s+", " "))
    return F.when(out != "", out)


def words_and_signs(text: Column) -> Column:
    """Tokens of a text: runs of word characters and single signs."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\w+|[^\w\s])"), F.lit(1))


def token_pair(first: Column, second: Column, most: int = 512) -> Column:
    """``[CLS] a [SEP] b [SEP]`` cut in proportion to ``most``, padded, with its mask, as struct(tokens, mask).

    Where both are too long together, the shorter is cut to int(size * room / total) and
    the longer gets the rest; of equal ones the second is cut in proportion.
    """
    room, a, b = most - 3, F.size(first), F.size(second)
    total = a + b
    cut_a = F.floor(a * room / F.greatest(total, F.lit(1))).cast("int")
    cut_b = F.floor(b * room / F.greatest(total, F.lit(1))).cast("int")
    fits = total <= room
    keep_a = F.when(fits, a).when(a < b, cut_a).otherwise(F.lit(room) - cut_b)
    keep_b = F.when(fits, b).when(a < b, F.lit(room) - cut_a).otherwise(cut_b)
    tokens = F.concat(F.array(F.lit("[CLS]")), F.slice(first, F.lit(1), keep_a), F.array(F.lit("[SEP]")), F.slice(second, F.lit(1), keep_b), F.array(F.lit("[SEP]")))
    pad = F.lit(most) - F.size(tokens)
    mask = F.concat(F.array_repeat(F.lit(1), F.size(tokens)), F.array_repeat(F.lit(0), pad))
    return F.struct(F.concat(tokens, F.array_repeat(F.lit("[PAD]"), pad)).alias("tokens"), mask.alias("mask"))


def fixed_vector(vector: Column, n: int) -> Column:
    """The vector as doubles, or n zeros if it is null or of another length."""
    return F.when(F.size(vector) == n, vector.cast("array<double>")).otherwise(F.array_repeat(F.lit(0.0), n))


def packed_vector(text: Column) -> Column:
    """Numbers from text such as ``1,2.5,3``; null if any part is no number."""
    parts = F.transform(F.split(text, ","), lambda x: x.try_cast("double"))
    return F.when(F.forall(parts, lambda x: x.isNotNull()), parts)
