"""Personal data by patterns, and information-theoretic sanitisation of the terms beside it; DataFrame functions only.

Pattern matches are the protected entities. A term (a word near an entity) reveals an entity as far as the corpus says
so: with df over distinct texts, PMI = log2(N * p(term | entity) / df(term)) approaches the entity's information content
IC = log2(N / df(entity)) as the term occurs with the entity only. p(term | entity) is shrunk towards the entity's group
(mail domain, network, first digits of a number), the group's towards the kind and the kind's towards df(term) / N, so
that entities seen once are judged as well. Terms with PMI >= disclosure * IC are spans of kind "term" wherever they
occur, and sanitising generalises them to what kind of thing they stand beside (entities are replaced by their kind).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyte.llm.shared import materialize

#: Fixed order of the kinds.
KINDS = ["email", "ip", "card", "phone"]

# The contract's patterns, written so that the Java matcher neither recurses deeply nor tries a run of characters from
# each of its places: runs are possessive, and a match starts where its first run does. For "email" it may also start
# where the last match ended, which is the one place inside a run where the plain pattern can still match.
_LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
WORD = r"\p{L}{4,}"


CHUNK = 256


def chunks_of(items: Column) -> Column:
    """The array in parts of CHUNK elements, one empty part for none."""

    def parts(held: Column) -> Column:
        last = F.greatest(F.ceil(F.size(held) / CHUNK).cast("int") - 1, F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(held, i * CHUNK + 1, CHUNK))

    return F.flatten(F.transform(F.array(items), parts))  # so the array is made once, not for each part


def scan(items: Column, state: str, out: str, start: Column, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """What step(state, item) gives for each item in order: (next state, array of type out to append).

    An array that grows by one element at each item is copied each time, which is quadratic in its length; within
    chunks that are appended whole, the copies are few.
    """
    none, nested = F.expr(f"cast(array() as array<{out}>)"), F.expr(f"cast(array() as array<array<{out}>>)")

    def one(acc: Column, x: Column) -> Column:
        then, new = step(acc["s"], x)
        return F.struct(then.cast(state).alias("s"), F.concat(acc["out"], new).alias("out"))

    def part(acc: Column, items: Column) -> Column:
        return F.aggregate(items, F.struct(acc["s"].alias("s"), none.alias("out")), one, lambda a: F.struct(a["s"].alias("s"), F.concat(acc["out"], F.array(a["out"])).alias("out")))

    return F.aggregate(chunks_of(items), F.struct(start.cast(state).alias("s"), nested.alias("out")), part, lambda acc: F.flatten(acc["out"]))


def spans_of(text: Column, pattern: Column | str) -> Column:
    """array<struct<s, e, v>> of the non-overlapping matches: code points, end exclusive.

    The text between matches and the matches themselves, laid end to end, give the places.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    found, between = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, -1)

    def place(at: Column, x: Column) -> tuple[Column, Column]:
        s = at + F.length(x["gap"])
        e = s + F.length(x["hit"])
        return e, F.array(F.struct(s.alias("s"), e.alias("e"), x["hit"].alias("v")))

    pairs = F.arrays_zip(found.alias("hit"), F.slice(between, 1, F.size(found)).alias("gap"))
    return scan(pairs, "int", "struct<s: int, e: int, v: string>", F.lit(0), place)


def _luhn(digits: Column) -> Column:
    def value(acc: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return acc + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), value) % 10 == 0


def _holds(kind: str, v: Column) -> Column:
    digits = F.regexp_replace(v, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(v, r"\."), lambda p: p.rlike(r"^0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.length(digits).between(16, 19) & _luhn(digits)
    return F.length(digits).between(8, 15) if kind == "phone" else F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """Spans of one kind; texts without the kind's needed character are not searched."""
    there = text.contains(_NEEDS[kind]) if _NEEDS[kind] else F.lit(True)
    searched = F.when(there & text.rlike("[0-9@]"), spans_of(text, PATTERNS[kind]))
    return F.coalesce(F.filter(searched, lambda x: _holds(kind, x["v"])), F.expr("cast(array() as array<struct<s: int, e: int, v: string>>)"))


def tagged(kind: str) -> Column:
    """The spans in column `kind`, each with its kind."""
    return F.transform(kind, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["v"].alias("v"), F.lit(kind).alias("kind")))


def told(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.concat_ws(":", F.lit(kind), x["s"].cast("string"), x["e"].cast("string")))


def _words(texts: DataFrame) -> DataFrame:
    """(__text, term), one row for each distinct word of a row."""
    return texts.select("__text", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))).alias("term"))


def group_of(kind: Column, v: Column) -> Column:
    """What entities of one kind share: the mail domain, the first three numbers of an IP, a card's first six digits, a
    phone's first four."""
    digits = F.regexp_replace(v, "[^0-9]", "")
    return (
        F.when(kind == "email", F.substring_index(v, "@", -1)).when(kind == "ip", F.substring_index(v, ".", 3))
        .when(kind == "card", F.substring(digits, 1, 6)).otherwise(F.substring(digits, 1, 4))
    )


#: Words of 64 bits in the filter over terms.
FILTER_WORDS = 1 << 20


def _bits(rows: DataFrame, key: str) -> DataFrame:
    """(slot, bits) of the hashes of column key, FILTER_WORDS rows at most, for _held."""
    slot, bit = _slot(key)
    return rows.groupBy(slot.alias("slot")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits"))


def _slot(key: str) -> tuple[Column, Column]:
    h = F.pmod(F.xxhash64(key), F.lit(FILTER_WORDS * 64))
    return F.shiftright(h, 6), h.bitwiseAND(F.lit(63)).cast("int")


def _held(rows: DataFrame, bits: DataFrame, key: str, held: bool = True) -> DataFrame:
    """Rows whose key may be among those of bits (all that are, and few others), or the rows that are not held."""
    slot, bit = _slot(key)
    is_held = F.coalesce(F.getbit("bits", bit) == 1, F.lit(False))
    return rows.withColumn("slot", slot).join(F.broadcast(bits), "slot", "left").filter(is_held if held else ~is_held).drop("slot", "bits")


def beside_spans(text: Column, spans: Column, window: int) -> Column:
    """array<struct<kind, v, near>>: each span with the distinct words of the `window` characters on either side. The text
    is cut once for each chunk of spans, so a long text with many spans is not searched from its start for each."""

    def words(x: Column, cut: Column) -> Column:
        at, s, e = cut["at"], x["s"] - cut["at"], x["e"] - cut["at"]
        around = F.concat_ws(" ", F.substr(cut["text"], F.greatest(s - window, F.lit(0)) + 1, F.least(x["s"], F.lit(window))), F.substr(cut["text"], e + 1, F.lit(window)))
        return F.struct(x["kind"].alias("kind"), x["v"].alias("v"), F.array_distinct(F.regexp_extract_all(around, F.lit(WORD), F.lit(0))).alias("near"))

    def part(items: Column) -> Column:
        first = F.greatest(F.array_min(F.transform(items, lambda x: x["s"])) - window, F.lit(0))
        last = F.array_max(F.transform(items, lambda x: x["e"])) + window
        cut = F.struct(first.alias("at"), F.substr(text, first + 1, last - first).alias("text"))
        return F.flatten(F.transform(F.array(cut), lambda c: F.transform(items, lambda x: words(x, c))))  # the cut is made once

    return F.flatten(F.transform(chunks_of(spans), part))


def revealing_terms(found: DataFrame, texts: DataFrame, disclosure: float, prior: float, window: int) -> DataFrame | None:
    """(__text, terms) for the texts that hold revealing terms, or None where there is no such term.

    found has __text (digest), text and all (base spans with kind) for texts that have spans; texts has __text and
    text for every row. All counts are over distinct texts of the whole corpus.
    """
    keys = ["kind", "group", "entity"]
    each = found.select("__text", F.explode(beside_spans(F.col("text"), F.col("all"), window)).alias("x"))
    x, value = F.col("x"), F.lower("x.v")
    named = each.select("__text", x["kind"].alias("kind"), group_of(x["kind"], value).alias("group"), value.alias("entity"), x["near"].alias("near"))
    beside = materialize(named.select("__text", *keys, F.explode("near").alias("term")).distinct(), "beside")
    entities = named.select("__text", *keys).distinct()

    def texts_by(rows: DataFrame, by: list[str], name: str) -> DataFrame:
        return rows.select("__text", *by).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias(name))

    n = texts.agg(F.count_distinct("__text")).first()[0]
    # Pairs are cut down to their distinct counts before each join by term, so a common term is a few rows.
    pairs = materialize(texts_by(beside, [*keys, "term"], "in_entity"), "pairs")
    pairs = pairs.join(materialize(texts_by(entities, keys, "of_entity"), "of_entity"), keys).filter(F.col("of_entity") < n)
    pairs = pairs.select("kind", "group", "term", "in_entity", "of_entity").distinct().join(texts_by(beside, ["kind", "group", "term"], "in_group"), ["kind", "group", "term"])
    pairs = pairs.join(materialize(texts_by(entities, keys[:2], "of_group"), "of_group"), keys[:2])
    pairs = pairs.select("kind", "term", "in_entity", "of_entity", "in_group", "of_group").distinct().join(texts_by(beside, ["kind", "term"], "in_kind"), ["kind", "term"])
    pairs = pairs.join(F.broadcast(texts_by(entities, ["kind"], "of_kind")), "kind")  # a row for each of KINDS
    # p(term | entity) is share + rest * df(term) / N, so PMI >= disclosure * IC says that the term is in at most `most` texts.
    share, rest = F.lit(0.0), F.lit(1.0)
    for level in ("kind", "group", "entity"):
        share = (F.col(f"in_{level}") + prior * share) / (F.col(f"of_{level}") + prior)
        rest = rest * prior / (F.col(f"of_{level}") + prior)
    most = F.lit(float(n)) * share / (F.pow(F.lit(float(n)) / F.col("of_entity"), F.lit(disclosure)) - rest)
    # Texts with entities alone rule out the terms that are common, before any word of the other texts is looked at.
    limits = materialize(pairs.groupBy("term").agg(F.max(most).alias("most")), "limits")
    of_found = _words(found).groupBy("term").agg(F.count(F.lit(1)).alias("of_found"))
    limits = materialize(limits.join(of_found, "term").filter(F.col("of_found") <= F.col("most")).select("term", "most"), "rare")
    if limits.isEmpty():
        return None
    seen = materialize(_held(_words(texts), _bits(limits, "term"), "term").join(limits, "term", "left_semi").distinct(), "seen")
    terms = limits.join(seen.groupBy("term").agg(F.count(F.lit(1)).alias("of_term")), "term").filter(F.col("of_term") <= F.col("most")).select("term")
    return materialize(seen.join(terms, "term").groupBy("__text").agg(F.sort_array(F.collect_set("term")).alias("terms")), "terms")


def find_personal_data(
    docs: DataFrame,
    disclosure: float = 0.95,
    prior: float = 0.25,
    window: int = 48,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_text: bool = True,
    carry: list[str] = (),
) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, and with keep_text: text, clean, n_term).

    One row per row of docs, over whole texts; a null text counts as empty (no spans). clean is the text with each
    base span replaced by [EMAIL], [IP], [CARD] or [PHONE] (where kinds overlap, the span that starts first, then the
    longer one, then the earlier kind) and each revealing term, outside those, by [TERM]. prior is the weight, in texts,
    of the wider share that a narrower one is shrunk towards. Repeated rows each get
    their row; copies of one text are one observation for the statistics. Empty table: no rows. Only the two named
    columns are read, and those in carry, which follow the result.
    """
    texts = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), texts.alias("text"), F.struct(F.lit(0), *carry).alias("__row")).withColumn("__text", F.sha2("text", 256))
    marked = rows.select("*", *[base_spans(F.col("text"), k).alias(k) for k in KINDS])
    base = marked.withColumn("all", F.concat(*[tagged(k) for k in KINDS]))
    found = materialize(base.filter(F.size("all") > 0).select("__text", "text", "all").dropDuplicates(["__text"]), "entities")
    terms = revealing_terms(found, rows.select("__text", "text"), disclosure, prior, window)
    none = F.expr("cast(array() as array<struct<s: int, e: int, v: string>>)")
    if terms is None:
        full = base.withColumn("term", none)
    else:
        quoted = F.transform("terms", lambda t: F.concat(F.lit(r"\Q"), t, F.lit(r"\E")))
        pattern = F.concat(F.lit(r"(?<!\p{L})(?:"), F.array_join(quoted, "|"), F.lit(r")(?!\p{L})"))
        bits = materialize(_bits(terms, "__text"), "bits")  # only texts that may hold terms are shuffled
        marked_up = _held(base, bits, "__text").join(terms, "__text", "left").withColumn("term", F.coalesce(F.when(F.col("terms").isNotNull(), spans_of(F.col("text"), pattern)), none)).drop("terms")
        full = marked_up.unionByName(_held(base, bits, "__text", held=False).withColumn("term", none))
    base_told = F.concat(*[told(k, F.col(k)) for k in KINDS])
    out = [
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(base_told, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base_told, told("term", F.col("term"))), ",").alias("spans"),
    ]
    if keep_text:
        full = _cleaned(full)
        out += ["text", "clean", F.size("term").cast("long").alias("n_term")]
    return full.select(*out, *[F.col(f"__row.{c}").alias(c) for c in carry])


def _cleaned(rows: DataFrame) -> DataFrame:
    """rows (text, all, term) with clean, the text with spans replaced: ordered passes that look at one span's end or
    start. Each pass is a column of its own, as an expression of all of them is too deep to be analysed."""
    order = F.array(*[F.lit(k) for k in KINDS])
    kind = "struct<s: int, e: int, kind: string>"
    plain = lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))
    some = lambda ok, x: F.when(ok, F.array(plain(x))).otherwise(F.expr(f"cast(array() as array<{kind}>)"))
    keyed = F.array_sort(F.transform("all", lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("neg"), F.array_position(order, x["kind"]).alias("k"), x["e"].alias("e"), x["kind"].alias("kind"))))
    rows = rows.withColumn("__keyed", keyed)
    base = scan(F.col("__keyed"), "int", kind, F.lit(0), lambda end, x: (F.greatest(end, F.when(x["s"] >= end, x["e"]).otherwise(end)), some(x["s"] >= end, x)))
    rows = rows.withColumn("__base", base)
    # Terms do not overlap one another; a term goes where a base span before it ends later or one after it starts earlier.
    both = F.array_sort(F.concat(F.transform("__base", plain), F.transform("term", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit("term").alias("kind")))))
    is_base = lambda x: x["kind"] != "term"
    rows = rows.withColumn("__both", both)
    after = scan(F.col("__both"), "int", kind, F.lit(0), lambda end, x: (F.when(is_base(x), x["e"]).otherwise(end), some(is_base(x) | (x["s"] >= end), x)))
    rows = rows.withColumn("__after", F.reverse(after))
    before = scan(F.col("__after"), "int", kind, F.lit(2147483647), lambda start, x: (F.when(is_base(x), x["s"]).otherwise(start), some(is_base(x) | (x["e"] <= start), x)))
    rows = rows.withColumn("__taken", F.when(F.size("term") == 0, F.col("__base")).otherwise(F.reverse(before)))

    def put(acc: Column, x: Column) -> Column:
        kept = F.substr(acc["cut"], acc["at"] - acc["from"] + 1, x["s"] - acc["at"])
        return F.struct(acc["cut"].alias("cut"), acc["from"].alias("from"), x["e"].alias("at"), F.concat(acc["out"], F.array(kept, F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")))).alias("out"))

    def part(acc: Column, items: Column) -> Column:
        end = F.greatest(acc["at"], F.coalesce(F.array_max(F.transform(items, lambda x: x["e"])), F.lit(0)))
        start = F.struct(F.substr("text", acc["at"] + 1, end - acc["at"]).alias("cut"), acc["at"].alias("from"), acc["at"].alias("at"), F.expr("cast(array() as array<string>)").alias("out"))
        return F.aggregate(items, start, put, lambda a: F.struct(a["at"].alias("at"), F.concat(acc["out"], F.array(F.array_join(a["out"], ""))).alias("out")))

    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))
    rest = lambda acc: F.array_join(F.concat(acc["out"], F.array(F.substr("text", acc["at"] + 1, F.length("text")))), "")
    clean = F.when(F.size("all") + F.size("term") == 0, F.col("text")).otherwise(F.aggregate(chunks_of(F.col("__taken")), start, part, rest))
    return rows.withColumn("clean", clean).drop("__keyed", "__base", "__both", "__after", "__taken")
