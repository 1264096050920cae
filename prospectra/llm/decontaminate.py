"""Benchmark decontamination by templates.

Numbers, names and units become typed placeholders, so a question that was asked anew
with other values keeps its template. A document holds an item if SPAN template tokens
in a row (or all tokens of a shorter item) agree, no GRAM of them in a row are all
slots, and over the span each slot value of the item stands for one value of the
document and back. A span with such a run of numbers and units is held if all its
tokens agree word for word, regardless of case, and so is an item of very few tokens.

Only places of a document at which a window of an item's tokens stands are looked at.
Item windows of LONG tokens are taken at every offset, document windows at multiples of
LONG: a span of 2 * LONG - 1 = SPAN tokens covers a whole document window, so none is
missed. A window that is found brings along the tokens around it, up to SPAN - LONG on
either side, and each span among them is joined with the items' spans by a signature: its
template with the places at which each value comes first, or its values, which is equal
for two spans exactly where one is held by the other. So pairs of a document and an item
are only made where a whole span agrees, however common its windows are. Shorter items
have windows of GRAM tokens or are one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, text_or_empty, unused

TOKEN = r"[\p{L}\p{M}]+|\p{Nd}+(?:[.,:/]\p{Nd}+)*|[%$€£]"
#: Letters of scripts that put no spaces between words (Thai, Lao, Burmese, Khmer, kana, Han).
SPACELESS = r"\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\x{20000}-\x{3FFFF}"
#: TOKEN, but each letter of SPACELESS is a token, with its marks.
PIECE = TOKEN.replace(r"[\p{L}\p{M}]+", rf"[\p{{L}}&&[{SPACELESS}]]\p{{M}}*|[\p{{L}}\p{{M}}&&[^{SPACELESS}]]+", 1)
#: Units written after (or before) a number.
UNITS = (
    "% $ € £ kg mg km cm mm ml lb lbs oz ft mi mph kmh hr hrs hours hour minutes minute seconds second"
    " percent dollars dollar euros euro cents pounds miles mile meters metres grams liters litres"
).split()
GRAM = 5
SPAN = 13
LONG = (SPAN + 1) // 2
#: Items with fewer tokens are held word for word only; those with fewer than IN_TEXT, which
#: any text may hold by chance, by a text that has no other token.
SHORTEST = 5
IN_TEXT = 3
#: Item windows (16 bytes each) and spans (some 500 bytes) up to which they are broadcast.
BROADCAST_WINDOWS, BROADCAST_SPANS = 1_000_000, 50_000
#: Longs of the map of item windows, a power of two; a map full of bits only spares nothing.
MAP_WORDS = 1 << 14
NUMBER, NAME, UNIT = "\ue000", "\ue001", "\ue002"


#: The two forms of a text: names as slots, names as words.
FORMS = ("named", "worded")


def _worded(token: Column) -> Column:
    """Placeholder of a number or unit, or the token in lower case."""
    low = F.lower(token)
    number = (token >= "0") & (token < ":") | F.substring(token, 1, 1).rlike(r"^\p{Nd}")
    return F.when(number, F.lit(NUMBER)).when(low.isin(UNITS), F.lit(UNIT)).otherwise(low)


def _named(token: Column, worded: Column) -> Column:
    """The same with a placeholder for a token that has a capital."""
    return F.when(~worded.isin(NUMBER, UNIT) & (token != worded), F.lit(NAME)).otherwise(worded)


def _read(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """``rows`` with the two forms of the tokens in ``raw``."""
    worded = rows.withColumn("worded", F.transform(raw, _worded))
    return worded.withColumn("named", F.zip_with(raw, "worded", _named))


def templates(rows: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns, raw tokens and the two forms of template tokens of each text."""
    text = text_or_empty(F.col("text").cast("string"))
    return _read(rows.select(*keep, F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)).alias("raw")))


def _slot(token: Column) -> Column:
    return token.isin(NUMBER, NAME, UNIT)


def _hashes(form: str, i: Column, length: int | Column) -> Column:
    """Hash of a window of a form. If all are slots it is null with names as slots, and that
    of the raw tokens with names as words. The form `raw` has the raw tokens' throughout."""
    length = F.lit(length) if isinstance(length, int) else length
    as_is = F.xxhash64(F.lit("raw"), F.transform(F.slice("raw", i + 1, length), F.lower))
    if form == "raw":
        return as_is
    part = F.slice(form, i + 1, length)
    return F.when(~F.forall(part, _slot), F.xxhash64(F.lit(form), part)).otherwise(as_is if form == "worded" else F.lit(None))


def _values(raw: str, template: str) -> Column:
    """What each token stands for: slots by type and value, others by themselves."""
    return F.zip_with(raw, template, lambda r, t: F.when(t.isin(NUMBER, NAME, UNIT), F.concat(t, F.lower(r))).otherwise(t))


def _signature(form: str, i: Column, n: Column) -> Column:
    """What two spans at i have in common exactly if one is held by the other. With names as
    slots or as words: the template, and for each token the first one that stands for the
    same, which agrees where the values are one to one. The form `raw`: the values."""
    if form == "raw":
        return F.concat(F.array(F.lit(form)), F.slice("worded_values", i + 1, n))
    values = F.slice(f"{form}_values", i + 1, n)
    return F.concat(F.array(F.lit(form)), F.slice(form, i + 1, n), F.transform(values, lambda v: F.array_position(values, v).cast("string")))


def _with_values(rows: DataFrame) -> DataFrame:
    return rows.withColumns({f"{f}_values": _values("raw", f) for f in FORMS})


def _step(n: int) -> tuple[int, int, tuple[str, ...]]:
    """(length, step, forms) of the windows that find spans of n tokens."""
    if n >= SPAN:
        return LONG, LONG, FORMS
    if n >= 2 * GRAM - 1:
        return GRAM, GRAM, FORMS
    return n, 1, FORMS if n >= SHORTEST else ("raw",)


def _item_windows(items: DataFrame, n: int) -> DataFrame:
    """(n, h): windows of the items with spans of n tokens, at every offset."""
    length, _, forms = _step(n)
    places = F.sequence(F.lit(0), F.size("worded") - F.lit(length))
    each = F.flatten(F.transform(places, lambda i: F.array(*[_hashes(f, i, length) for f in forms])))
    return items.filter(F.col("n") == n).select("n", F.explode(each).alias("h")).filter("h is not null")


def _item_spans(items: DataFrame) -> DataFrame:
    """(n, s, h, item_id, item_tokens): signatures of the items' spans. One with GRAM slots
    in a row, or of few tokens, has that of its values only."""
    n = F.col("n")

    def fits(form: str, i: Column) -> Column:
        last = i + n - GRAM
        return (n >= SHORTEST) & ~F.exists(F.sequence(i, F.greatest(i, last)), lambda k: F.forall(F.slice(form, k + 1, GRAM), _slot))

    def of(i: Column) -> Column:
        own = [F.when(fits(f, i), _signature(f, i, n)) for f in FORMS]
        return F.array_compact(F.array(*own, F.when(~fits("worded", i), _signature("raw", i, n))))

    spans = F.flatten(F.transform(F.sequence(F.lit(0), F.size("worded") - n), of))
    each = _with_values(items).select("item_id", F.size("worded").cast("long").alias("item_tokens"), "n", F.explode(spans).alias("s"))
    return each.withColumn("h", F.xxhash64("s")).distinct()


def _bitmap(windows: DataFrame) -> DataFrame:
    """(bits): 64 * MAP_WORDS bits as one array of longs, in which that of each window is
    set. It spares most windows of documents the way to the join, and leaves out none."""
    word, bit = _map_place(F.col("h"))
    set_bits = windows.groupBy(word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("set"))
    every = windows.sparkSession.range(MAP_WORDS).select(F.col("id").cast("int").alias("word")).join(set_bits, "word", "left")
    entry = F.struct("word", F.coalesce("set", F.lit(0).cast("long")).alias("set"))
    return every.agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["set"]).alias("bits"))


def _map_place(h: Column) -> tuple[Column, Column]:
    return h.bitwiseAND(F.lit(MAP_WORDS - 1)).cast("int"), F.shiftright(h, 32).bitwiseAND(F.lit(63)).cast("int")


def _in_map(h: Column) -> Column:
    word, bit = _map_place(h)
    return F.getbit(F.get("_bits", word), bit) == 1


def _doc_windows(n: int) -> Column:
    """Windows of a document that may lie in a span of n tokens: (n, hashes, tokens around).
    Only those whose bit is set in the map get their tokens."""
    length, step, forms = _step(n)
    size = F.size("raw")

    def hashed(i: Column) -> Column:
        return F.struct(i.alias("at"), F.filter(F.array_compact(F.array(*[_hashes(f, i, length) for f in forms])), _in_map).alias("hashes"))

    def window(w: Column) -> Column:
        i = w["at"]
        base = F.greatest(F.lit(0), i - (n - length))
        return F.struct(F.lit(n).alias("n"), w["hashes"].alias("hashes"), F.slice("raw", base + 1, i - base + n).alias("around"))

    places = F.transform(F.sequence(F.lit(0), size - length, F.lit(step)), hashed)
    found = F.transform(F.filter(places, lambda w: F.size(w["hashes"]) > 0), window)
    return F.when((size >= n) if n >= IN_TEXT else (size == n), found)


def _small(df: DataFrame, most: int) -> DataFrame:
    """A stored table, to be broadcast if it has at most so many rows."""
    return F.broadcast(df) if df.count() <= most else df


def _held(docs: DataFrame, benchmark: DataFrame, *key: str) -> DataFrame:
    """(key, item_id, item_tokens), distinct: documents, told by ``key``, that hold an item."""
    size = F.size("worded")
    items = cut(templates(benchmark.select("item_id", "text"), "item_id").filter(size > 0).withColumn("n", F.least(size, F.lit(SPAN))))
    kinds = sorted(r[0] for r in items.select("n").distinct().collect())  # SPAN at most
    if not kinds:
        return docs.select(*key).limit(0).crossJoin(items.select("item_id", size.cast("long").alias("item_tokens")).limit(0))
    windows = _item_windows(items, kinds[0])
    for n in kinds[1:]:
        windows = windows.unionByName(_item_windows(items, n))
    windows = cut(windows.distinct())
    bits = cut(_bitmap(windows))
    windows, spans = _small(windows, BROADCAST_WINDOWS), _small(cut(_item_spans(items)), BROADCAST_SPANS)
    none = F.expr("cast(array() AS array<struct<n: int, hashes: array<bigint>, around: array<string>>>)")
    every = F.flatten(F.array(none, *[F.coalesce(_doc_windows(n), none) for n in kinds]))
    places = templates(docs, *key).withColumn("_bits", bits.scalar()).select(*key, F.explode(every).alias("w"))
    hashed = places.select(*key, "w.n", "w.around", F.explode("w.hashes").alias("h"))
    near = _with_values(_read(hashed.join(windows, ["n", "h"], "left_semi").select(*key, "n", F.col("around").alias("raw"))))
    starts = F.sequence(F.lit(0), F.size("raw") - F.col("n"))
    mine = F.flatten(F.transform(starts, lambda i: F.array(*[_signature(f, i, F.col("n")) for f in (*FORMS, "raw")])))
    signed = near.filter(F.size("raw") >= F.col("n")).select(*key, "n", F.explode(F.array_distinct(mine)).alias("_mine")).withColumn("h", F.xxhash64("_mine"))
    return signed.join(spans, ["n", "h"]).filter(F.col("_mine") == F.col("s")).select(*key, "item_id", "item_tokens").distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, item_tokens): documents that hold an item, with the number of
    the item's tokens. One row for each such pair of ids.

    Null texts and texts without a token hold nothing and are held by none. Documents with
    a null id cannot be named and are left out here; drop_contaminated() judges them too.
    Spans with GRAM slots in a row and items of fewer than SHORTEST tokens are held only
    word for word. Rows repeated with one id count once, as do ties between spans. A text
    of any length is read whole. Other columns are ignored. Empty tables give an empty
    result.
    """
    return _held(docs.select("doc_id", "text").filter("doc_id is not null"), benchmark, "doc_id")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item, columns unchanged whatever their names.

    Rows repeated with one id go together; rows with a null id are told by their texts, so
    they stay or go like any other. Null, empty and very long texts are judged as in
    contaminated(); empty tables give an empty result, an empty benchmark all rows.
    """
    bad_id, bad_text, of = unused(docs, "bad_id", "bad_text", "of")
    text = F.when(F.col("doc_id").isNull(), F.sha2(F.encode(text_or_empty(F.col("text").cast("string")), "UTF-8"), 256))
    told = docs.select("doc_id", "text", text.alias("_text"))
    bad = cut(_held(told, benchmark, "doc_id", "_text").select(F.col("doc_id").alias(bad_id), F.col("_text").alias(bad_text)).distinct())
    # their size is known from what is stored: Spark broadcasts few ids and shuffles many
    rows = docs.withColumn(of, text)
    return rows.join(bad, F.col("doc_id").eqNullSafe(F.col(bad_id)) & F.col(of).eqNullSafe(F.col(bad_text)), "left_anti").drop(of)
