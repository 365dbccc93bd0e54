"""Benchmark decontamination by canonical templates.

Numbers, units after numbers and names become typed placeholders; the rest is lower
case without punctuation. A name is any capitalised word, at the start of a sentence
too, so a word's form does not depend on what stands before it. Windows of ``WIDTH`` words of this form are
hashed on both sides and joined, so a question with other numbers or names still meets
its source. A match says where the document runs along an item; the placeholders on
that stretch are then compared: each value of the item must stand for one value of the
document throughout, else the words agree by chance.

A document is contaminated by an item when a consistent stretch covers ``min_words``
words, or the whole item if that is shorter. Windows with fewer than ``min_literal``
distinct literal words say nothing and are not used; where an item has such windows, a
stretch found by others is followed over them word by word. Items shorter than a window
are one window; documents are cut to windows of every width that items need.

Beside the templates every item, however short or numeric, is looked for word for word:
windows of its lower-case words that cover it whole must all be met at one place.

The items' windows are counted first and broadcast only up to ``max_broadcast`` of
them (16 bytes each), else both sides are shuffled by hash. The texts themselves are
never shuffled while the matched documents are few: their ids, counted too, go to a
second scan.

Defined cases: null or empty texts match nothing; equal items count as the one with the
smallest id; equal rows of documents give equal rows; empty tables give an empty
result. Extra columns are not read.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.llm.common import settle

WIDTH = 8
NAME, NUMBER, UNIT = "\u0001", "\u0002", "\u0003"
#: Units that may follow a number.
UNITS = ("mm cm m km mg g kg t ml l s sec seconds min minutes h hours days weeks months years percent dollars euros usd eur pounds "
         "miles feet inches meters metres degrees").split()
_NAME = r"(?<![\p{L}\p{N}])\p{Lu}\p{Ll}+(?![\p{L}\p{N}])"
_NUMBER = r"\p{N}+(?:[.,]\p{N}+)*+"
_UNIT = rf"(?<=\x02 ) *(?:{'|'.join(UNITS)})(?!\p{{L}})"
_OTHER = r"[^\p{L}\p{N}\x01-\x03]+"


def _named(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, NAME + NUMBER + UNIT, "   "), _NAME, NAME)


def _numbered(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, _NUMBER, f" {NUMBER} "), _UNIT, UNIT + " ")


def template_words(text: Column) -> Column:
    """The words of the canonical form; an empty list for null and empty texts."""
    plain = F.regexp_replace(F.lower(_numbered(_named(text))), _OTHER, " ")
    return F.filter(F.split(F.coalesce(plain, F.lit("")), " "), lambda w: w != "")


def plain_words(text: Column) -> Column:
    """The lower-case words, numbers and names as they are; an empty list for null and empty texts."""
    return F.filter(F.split(F.coalesce(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), F.lit("")), " "), lambda w: w != "")


def slot_values(text: Column) -> Column:
    """What the placeholders stand for, per kind and in order."""
    named = _named(text)
    return F.struct(F.regexp_extract_all(F.translate(text, NAME + NUMBER + UNIT, "   "), F.lit(f"({_NAME})"), 1).alias("names"),
                    F.regexp_extract_all(named, F.lit(f"({_NUMBER})"), 1).alias("numbers"),
                    F.regexp_extract_all(F.regexp_replace(named, _NUMBER, f" {NUMBER} "), F.lit(f"({_UNIT})"), 1).alias("units"))


def with_windows(df: DataFrame, words: str, width: int) -> DataFrame:
    """Adds ``windows``: the hash of every window of ``width`` words, from hashes of shorter ones; none if there are fewer words.

    Each step is a projection of its own, so no list is computed twice. Explode the windows with an outer
    generator: for others the optimizer adds a filter on the list's size, which computes it again.
    """
    out, have = df.withColumn("windows", F.transform(words, lambda w: F.xxhash64(w))), 1
    while have < width:
        step = min(have, width - have)
        n = F.greatest(F.size("windows") - step, F.lit(0))
        out = out.withColumn("windows", F.zip_with(F.slice("windows", 1, n), F.slice("windows", step + 1, n), lambda a, b: F.xxhash64(a, b)))
        have += step
    return out


def item_windows(benchmark: DataFrame, id: str, text: str, width: int, min_literal: int) -> DataFrame:
    """(key, item_id, item_pos, n_item, gaps) of telling windows; ``gaps``: the item has others too. ``benchmark`` has distinct texts."""
    items = benchmark.select(F.col(id).alias("item_id"), template_words(F.col(text)).alias("w"))
    literal = lambda s: F.size(F.array_distinct(F.filter(s, lambda x: ~x.isin(NAME, NUMBER, UNIT))))
    telling = lambda w, i: literal(F.slice(w, i + 1, width)) >= min_literal
    items = with_windows(items, "w", width)
    gaps = F.exists(F.transform("windows", lambda _, i: ~telling(F.col("w"), i)), lambda x: x)
    rows = items.select("item_id", "w", F.size("w").alias("n_item"), gaps.alias("gaps"), F.posexplode_outer("windows").alias("item_pos", "key"))
    return rows.where(telling(F.col("w"), F.col("item_pos"))).select("key", "item_id", "item_pos", "n_item", "gaps")


def verbatim(own: DataFrame, items: DataFrame, max_broadcast: int) -> DataFrame:
    """(doc_id, text_hash, item_id, n_words, n_slots): documents that hold all words of an item in a row."""
    read = settle(items.select("item_id", plain_words(F.col("text")).alias("w"), F.size(template_words(F.col("text"))).cast("long").alias("n_words")).where(F.size("w") > 0))
    found = None
    for width in [r[0] for r in read.select(F.least(F.size("w"), F.lit(WIDTH)).alias("n")).distinct().collect()]:  # at most WIDTH of them
        last = F.size("w") - width
        of = with_windows(read.where(F.least(F.size("w"), F.lit(WIDTH)) == width), "w", width)
        places = F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(width)), F.array(last)))  # they cover the item
        keys = of.select("item_id", "n_words", F.size(places).alias("n_keys"), "windows", F.explode(places).alias("item_pos"))
        keys = settle(keys.select(F.get("windows", F.col("item_pos")).alias("key"), "item_id", "item_pos", "n_words", "n_keys"))
        small = keys.count() <= max_broadcast
        at = with_windows(own.select("doc_id", "text_hash", plain_words(F.col("text")).alias("w")), "w", width)
        at = at.select("doc_id", "text_hash", F.posexplode_outer("windows").alias("pos", "key"))
        whole = (at.join(F.broadcast(keys) if small else keys, "key")
                 .groupBy("doc_id", "text_hash", "item_id", "n_words", "n_keys", (F.col("pos") - F.col("item_pos")).alias("shift"))
                 .agg(F.size(F.collect_set("item_pos")).alias("met")).where("met = n_keys")
                 .select("doc_id", "text_hash", "item_id", "n_words", F.lit(0).cast("long").alias("n_slots")))
        found = whole if found is None else found.unionByName(whole)
    return found if found is not None else own.select("doc_id", "text_hash").where("false").crossJoin(
        read.select("item_id", "n_words", F.lit(0).cast("long").alias("n_slots")))


def contaminated(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
                 min_words: int = 13, min_literal: int = 5, max_broadcast: int = 2_000_000) -> DataFrame:
    """(doc_id, text_hash, item_id, n_words, n_slots): the items that a document holds, by their longest consistent stretch."""
    own = docs.select(F.col(f"`{id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.xxhash64(F.col(f"`{text}`")).alias("text_hash"))
    items = (benchmark.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{item_text}`").alias("text"))
             .groupBy("text").agg(F.min("item_id").alias("item_id")))
    short = items.where(F.size(template_words(F.col("text"))) < WIDTH)
    widths = [WIDTH] + [r[0] for r in short.select(F.size(template_words(F.col("text"))).alias("n")).distinct().collect() if r[0] >= min_literal]
    matches = None
    for width in widths:  # at most WIDTH of them
        of = items if width == WIDTH else short.where(F.size(template_words(F.col("text"))) == width)
        keys = settle(item_windows(of, "item_id", "text", width, min_literal))
        small = keys.count() <= max_broadcast
        words = own.select("doc_id", "text_hash", template_words(F.col("text")).alias("w"))
        at = with_windows(words, "w", width).select("doc_id", "text_hash", F.posexplode_outer("windows").alias("pos", "key"))
        hits = at.join(F.broadcast(keys) if small else keys, "key").groupBy(
            "doc_id", "text_hash", "item_id", "n_item", "gaps", (F.col("pos") - F.col("item_pos")).alias("shift")).agg(
            F.min("item_pos").alias("a"), (F.max("item_pos") + width).alias("b"))
        matches = hits if matches is None else matches.unionByName(hits)
    enough = F.col("b") - F.col("a") >= F.least(F.lit(min_words), F.col("n_item"))
    stretch = settle(matches.where(enough | F.col("gaps")))

    wanted = stretch.select("doc_id", "text_hash").distinct()
    wanted = F.broadcast(wanted) if stretch.count() <= max_broadcast else wanted
    same = (F.col("d.text_hash") == F.col("m.text_hash")) & F.col("d.doc_id").eqNullSafe(F.col("m.doc_id"))
    texts = (own.alias("d").join(wanted.alias("m"), same, "left_semi").dropDuplicates(["doc_id", "text_hash"])
             .select("doc_id", "text_hash", template_words(F.col("text")).alias("dw"), slot_values(F.col("text")).alias("dv")))
    sources = items.select("item_id", template_words(F.col("text")).alias("iw"), slot_values(F.col("text")).alias("iv"))
    both = (stretch.alias("m").join(texts.alias("d"), same).drop("d.doc_id", "d.text_hash")
            .select("m.*", "dw", "dv").join(sources, "item_id"))
    # Over windows that say nothing the words are compared: up to the last that differs before the stretch and the first after it.
    differ = F.filter(F.sequence(F.lit(0), F.col("n_item") - 1), lambda i: ~F.get("iw", i).eqNullSafe(F.when(i + F.col("shift") >= 0, F.get("dw", i + F.col("shift")))))
    both = both.withColumn("differ", F.when(F.col("gaps"), differ).otherwise(F.array().cast("array<int>")))
    both = both.withColumn("upto", F.when(F.col("gaps"), F.coalesce(F.array_min(F.filter("differ", lambda i: i >= F.col("b"))), F.col("n_item"))).otherwise(F.col("b")))
    both = both.withColumn("from", F.when(F.col("gaps"), F.coalesce(F.array_max(F.filter("differ", lambda i: i < F.col("a"))) + 1, F.lit(0))).otherwise(F.col("a")))
    both = both.drop("differ", "a", "b").withColumnsRenamed({"from": "a", "upto": "b"}).where(enough)

    def value(words: Column, values: Column, i: Column) -> Column:
        """What the placeholder at place ``i`` (from 1) stands for."""
        w = F.element_at(words, i)
        nth = F.size(F.filter(F.slice(words, 1, i), lambda x: x == w)) - 1
        return F.lower(F.when(w == NAME, F.get(values["names"], nth)).when(w == NUMBER, F.get(values["numbers"], nth))
                       .otherwise(F.trim(F.get(values["units"], nth))))

    places = F.filter(F.sequence(F.col("a") + 1, F.col("b")), lambda i: F.element_at("iw", i).isin(NAME, NUMBER, UNIT))
    pairs = F.transform(places, lambda i: F.struct(F.element_at("iw", i).alias("kind"), value(F.col("iw"), F.col("iv"), i).alias("item"),
                                                   value(F.col("dw"), F.col("dv"), (i + F.col("shift")).cast("int")).alias("doc")))
    checked = both.withColumn("pairs", F.array_distinct(pairs))
    meant = F.array_distinct(F.transform("pairs", lambda p: F.struct(p["kind"], p["item"])))
    alike = checked.where(F.size("pairs") == F.size(meant)).select(
        "doc_id", "text_hash", "item_id", (F.col("b") - F.col("a")).cast("long").alias("n_words"), F.size("pairs").cast("long").alias("n_slots"))
    return (alike.unionByName(verbatim(own, items, max_broadcast)).groupBy("doc_id", "text_hash", "item_id")
            .agg(F.max("n_words").alias("n_words"), F.max("n_slots").alias("n_slots")))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without the contaminated rows; all columns stay."""
    bad = settle(contaminated(docs, benchmark, id, text, **options).select("doc_id", "text_hash").distinct())
    bad = F.broadcast(bad) if bad.count() <= options.get("max_broadcast", 2_000_000) else bad
    d = docs.alias("d")
    same = (F.xxhash64(F.col(f"d.`{text}`")) == F.col("m.text_hash")) & F.col(f"d.`{id}`").eqNullSafe(F.col("m.doc_id"))
    return d.join(bad.alias("m"), same, "left_anti")
