"""Operator 7, document fingerprints as invertible Bloom lookup tables, in DataFrame functions only.

A text is cut into paragraphs: lines, and long lines by their content, behind each word whose digest, taken with the
next word's, is divisible by PIECE_WORDS, and at the latest after MOST_WORDS words. So a word put in or taken out changes the
pieces around it only. The set of their XXH64 digests is
dealt by hash into groups, the least power of two that leaves LOAD digests or fewer to a group on average, and each group
goes into a table of three rows of CELLS cells; a cell holds how many digests fell into it, their XOR, and the XOR of
their check values. The fingerprint is the number of digests and these tables. So it grows with the text, and the work
does too: dealing is one sort, and a table is of one size however long the text is.

Two fingerprints of one number of groups are subtracted cell by cell, so that common digests vanish, and peeled: a cell
with a single digest left gives it away, it is taken out of its other cells, and so on. What comes out are the digests
that only one of the two has, hence the likeness: common digests over all digests. A table has room for two unlike groups
of LOAD digests, so unlike texts peel as well. If the numbers of groups differ, the smaller fingerprint is peeled by
itself, which lists its digests, and dealt out anew. All this needs the fingerprints only, and `likeness_of_written()`
does it for two stored ones.

A group that does not peel is retried larger, from the digests of that group: with a table four and then sixteen times as
large, under other hashes. The query says of how many groups that was needed.

The next document is found on identifiers alone: they are dealt out by range, each range is looked through by itself,
and range ends meet in a table of one row for each range. Then a document sends its predecessor only what that needs:
the characters for the edit and its digests. Whole texts are shuffled once.

Edge cases: null text is empty and has no digests; two texts without digests have likeness 1; documents are in order of
(doc_id, hash of the text), null doc_id first; rows equal in both are one document and all come out alike; a single
document is its own next; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlark.llm.secrets import let
from ledgerlark.llm.shared import cut, table

PIECE_WORDS = 32
MOST_WORDS = 128
LOAD = 12
CELLS = 32  # in each of the three rows
RETRIES = (4, 16)  # times as many
ROUNDS = 16
CHECK_BITS = 28
COUNT_BITS = 12  # as written; no cell of LOAD digests on average comes near
#: A word and the white space behind it, or white space that a text begins with. Java's classes are the contract's.
UNIT = r"\S++\s*+|^\s++"
FIRST = (CELLS, 0)  # cells and seed of the tables of a fingerprint
EMPTY = "-"  # a cell in which nothing fell, in writing


def digests(text: Column) -> Column:
    """The distinct digests of a text's paragraphs."""

    def pieces(words: Column, hashes: Column) -> Column:
        last = F.size(words) - 1

        def is_end(i: Column) -> Column:
            pair = F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1))
            return (i == last) | (F.pmod(pair, F.lit(PIECE_WORDS)) == 0) | F.contains(F.get(words, i), F.lit("\n"))

        def between(ends: Column) -> Column:
            """The digests of the words behind each end, up to the next one, MOST_WORDS at a time."""

            def of(end: Column, i: Column) -> Column:
                begin = F.coalesce(F.get(ends, i - 1) + 1, F.lit(0))
                starts = F.sequence(begin, end, F.lit(MOST_WORDS))
                return F.transform(starts, lambda at: F.xxhash64(F.slice(hashes, at + 1, F.least(F.lit(MOST_WORDS), end + 1 - at))))

            return F.flatten(F.transform(ends, of))

        ends = F.filter(F.sequence(F.lit(0), last), is_end)
        return F.when(last < 0, F.array().cast("array<long>")).otherwise(F.array_distinct(let(ends, between)))

    words = F.regexp_extract_all(text, F.lit(UNIT), F.lit(0))
    return let(words, lambda ws: let(F.transform(ws, lambda w: F.xxhash64(w)), lambda hs: pieces(ws, hs)))


def check_of(key: Column) -> Column:
    return F.xxhash64(key, F.lit(-1)).bitwiseAND(F.lit((1 << CHECK_BITS) - 1))


def placed(key: Column, cells: Column, seed: Column) -> Column:
    """A digest with its check value and its cell in each row."""
    at = [F.pmod(F.xxhash64(key, seed + row), cells).cast("int").alias(f"at{row}") for row in range(3)]
    return F.struct(key.alias("key"), check_of(key).alias("check"), *at)


def cell(count: Column, key: Column, check: Column) -> Column:
    return F.struct(count.alias("count"), key.alias("key"), check.alias("check"))


def sketch(keys: Column, cells: Column, seed: Column) -> Column:
    """The cells of a set of digests, row by row."""
    zero = F.lit(0).cast("long")

    def add(acc: Column, x: Column) -> Column:
        return cell(acc["count"] + 1, acc["key"].bitwiseXOR(x["key"]), acc["check"].bitwiseXOR(x["check"]))

    def row(xs: Column, r: int) -> Column:
        return F.transform(
            F.sequence(F.lit(0), cells - 1),
            lambda i: F.aggregate(F.filter(xs, lambda x: x[f"at{r}"] == i), cell(F.lit(0), zero, zero), add),
        )

    return let(F.transform(keys, lambda k: placed(k, cells, seed)), lambda xs: F.concat(*(row(xs, r) for r in range(3))))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(
        a,
        b,
        lambda x, y: cell(
            x["count"] - y["count"], x["key"].bitwiseXOR(y["key"]), x["check"].bitwiseXOR(y["check"])
        ),
    )


def peel(difference: Column, cells: Column, seed: Column) -> Column:
    """(ok, a_only, b_only): whether all digests came out, and those of either side.

    Each round takes out the digests of all cells that hold just one.
    """
    none = F.array().cast("array<long>")

    def out(acc: Column, p: Column) -> Column:
        return cell(acc["count"] - p["sign"], acc["key"].bitwiseXOR(p["key"]), acc["check"].bitwiseXOR(p["check"]))

    def without(all_cells: Column, found: Column) -> Column:
        def row(r: int) -> Column:
            return F.transform(
                F.slice(all_cells, cells * r + 1, cells),
                lambda x, i: F.aggregate(F.filter(found, lambda p: p[f"at{r}"] == i), x, out),
            )

        return F.concat(*(row(r) for r in range(3)))

    def single(x: Column) -> Column:
        return (F.abs(x["count"]) == 1) & (check_of(x["key"]) == x["check"])

    def signed(ps: Column, sign: int) -> Column:
        return F.transform(F.filter(ps, lambda p: p["sign"] == sign), lambda p: p["key"])

    def state(all_cells: Column, a_only: Column, b_only: Column, live: Column) -> Column:
        return F.struct(all_cells.alias("cells"), a_only.alias("a_only"), b_only.alias("b_only"), live.alias("live"))

    def step(acc: Column, _: Column) -> Column:
        singles = F.array_distinct(
            F.transform(
                F.filter(acc["cells"], single), lambda x: F.struct(x["key"].alias("key"), x["count"].alias("count"))
            )
        )

        def taken(ps: Column) -> Column:
            return state(
                without(acc["cells"], ps),
                F.concat(acc["a_only"], signed(ps, 1)),
                F.concat(acc["b_only"], signed(ps, -1)),
                F.size(ps) > 0,
            )

        with_places = F.transform(singles, lambda x: placed(x["key"], cells, seed).withField("sign", x["count"]))
        return F.when(acc["live"], let(with_places, taken)).otherwise(acc)

    def result(acc: Column) -> Column:
        return F.struct(
            F.forall(acc["cells"], lambda x: (x["count"] == 0) & (x["key"] == 0) & (x["check"] == 0)).alias("ok"),
            acc["a_only"].alias("a_only"),
            acc["b_only"].alias("b_only"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), state(difference, none, none, F.lit(True)), step, result)


def only(a: Column, b: Column) -> Column:
    """(ok, a_only, b_only) of a group's two sets of digests, by tables that grow until one peels."""

    def tried(acc: Column, times: Column) -> Column:
        cells = times * CELLS
        both = F.transform(F.array(a, b), lambda keys: sketch(keys, cells, times))
        larger = let(both, lambda x: peel(subtract(F.get(x, F.lit(0)), F.get(x, F.lit(1))), cells, times))
        return F.when(acc["ok"], acc).otherwise(larger)

    none = F.array().cast("array<long>")
    start = F.struct(F.lit(False).alias("ok"), none.alias("a_only"), none.alias("b_only"))
    # Sixteen times the cells leave one case in many millions, in which the sets themselves are compared.
    sets = F.struct(F.lit(True).alias("ok"), F.array_except(a, b).alias("a_only"), F.array_except(b, a).alias("b_only"))
    return F.aggregate(F.array(*map(F.lit, RETRIES)), start, tried, lambda t: F.when(t["ok"], t).otherwise(sets))


def groups_for(n: Column) -> Column:
    """The least power of two that leaves LOAD of n digests or fewer to a group."""
    return F.when(n <= LOAD, 1).otherwise(F.pow(F.lit(2), F.length(F.bin(F.floor((n - 1) / LOAD)))).cast("int"))


def dealt(keys: Column, groups: Column) -> Column:
    """The digests of each group: all are sorted by group behind a mark for each, and cut at the marks."""
    entry = lambda g, real, key: F.struct(g.cast("int").alias("g"), F.lit(real).alias("real"), key.alias("key"))
    marks = F.transform(F.sequence(F.lit(0), groups - 1), lambda g: entry(g, 0, F.lit(0).cast("long")))
    every = F.transform(keys, lambda k: entry(F.pmod(F.xxhash64(k, F.lit(77)), groups), 1, k))

    def between(xs: Column, starts: Column) -> Column:
        def of(at: Column, g: Column) -> Column:
            end = F.coalesce(F.get(starts, g + 1), F.size(xs))
            return F.transform(F.slice(xs, at + 2, end - at - 1), lambda x: x["key"])

        return F.transform(starts, of)

    def at_marks(xs: Column) -> Column:
        starts = F.filter(F.transform(xs, lambda x, i: F.when(x["real"] == 0, i)), lambda i: i.isNotNull())
        return let(starts, lambda s: between(xs, s))

    return F.when(groups == 1, F.array(keys)).otherwise(let(F.sort_array(F.concat(marks, every)), at_marks))


def tables_of(keys: Column, groups: Column) -> Column:
    return let(dealt(keys, groups), lambda parts: F.transform(parts, lambda p: sketch(p, *map(F.lit, FIRST))))


def fingerprint(keys: Column) -> Column:
    """(n, tables, keys) of a set of digests."""
    tables = tables_of(keys, groups_for(F.size(keys)))
    return F.struct(F.size(keys).alias("n"), tables.alias("tables"), keys.alias("keys"))


def in_groups(side: Column, groups: Column) -> Column:
    """The tables of side(n, tables, keys) dealt out in so many groups.

    That takes its digests, which its tables list; if one does not, they are keys, and the result is null if these are.
    """

    def again(parts: Column) -> Column:
        listed = F.flatten(F.transform(parts, lambda p: p["a_only"]))
        return tables_of(F.when(F.forall(parts, lambda p: p["ok"]), listed).otherwise(side["keys"]), groups)

    listed = let(F.transform(side["tables"], lambda t: peel(t, *map(F.lit, FIRST))), again)
    return F.when(F.size(side["tables"]) == groups, side["tables"]).otherwise(listed)


def likeness(a: Column, b: Column) -> Column:
    """(near, retried) of two fingerprints (n, tables, keys): common digests over all digests, and groups to be retried.

    keys, the sets of digests, are for those groups only; where they are null, near is null if there are such groups.
    """

    def of(groups: Column) -> Column:
        tables = F.transform(F.array(a, b), lambda side: in_groups(side, groups))
        differences = lambda x: F.zip_with(F.get(x, F.lit(0)), F.get(x, F.lit(1)), subtract)
        parts = let(tables, lambda x: F.transform(differences(x), lambda d: peel(d, *map(F.lit, FIRST))))
        return let(parts, lambda ps: told(ps, groups))

    def told(parts: Column, groups: Column) -> Column:
        failed = F.size(F.filter(parts, lambda p: ~p["ok"]))
        done = F.when(failed == 0, parts).otherwise(retried(parts, groups))
        return F.struct(let(done, near).alias("near"), failed.cast("long").alias("retried"))

    def retried(parts: Column, groups: Column) -> Column:
        own = F.transform(F.array(a, b), lambda side: dealt(side["keys"], groups))
        group = lambda x, side, g: F.get(F.get(x, F.lit(side)), g)
        return let(
            own,
            lambda x: F.transform(
                parts, lambda p, g: F.when(p["ok"], p).otherwise(only(group(x, 0, g), group(x, 1, g)))
            ),
        )

    def near(parts: Column) -> Column:
        apart = F.aggregate(parts, F.lit(0), lambda acc, p: acc + F.size(p["a_only"]) + F.size(p["b_only"]))
        every = a["n"] + b["n"]
        common = (every - apart) / 2
        known = F.when(every == 0, 1.0).otherwise(common / (every - common))
        return F.when(F.forall(parts, lambda p: p["ok"]), known)

    return let(F.greatest(F.size(a["tables"]), F.size(b["tables"])), of)


def written(print_: Column) -> Column:
    """A fingerprint as text: the number of digests, then of each table count, XOR and check of the cells in base 64."""
    digits = (COUNT_BITS // 4, 16, CHECK_BITS // 4)  # 13 bytes, 18 characters without padding

    def part(x: Column) -> Column:
        shown = F.concat(*(F.lpad(F.hex(x[c]), n, "0") for c, n in zip(("count", "key", "check"), digits, strict=True)))
        return F.when(x["count"] == 0, EMPTY).otherwise(F.substring(F.base64(F.unhex(shown)), 1, 18))

    tables = F.transform(print_["tables"], lambda t: F.array_join(F.transform(t, part), ""))
    return F.concat(print_["n"].cast("string"), F.lit(":"), F.array_join(tables, "."))


def read_back(text: Column) -> Column:
    """The fingerprint that was written so."""
    number = lambda x, at, n: F.conv(F.substring(x, at, n), 16, -10).cast("long")
    zero = F.lit(0).cast("long")
    ends = (1, 1 + COUNT_BITS // 4, 17 + COUNT_BITS // 4)

    def part(x: Column) -> Column:
        full = let(
            F.hex(F.unbase64(F.concat(x, F.lit("==")))),
            lambda h: cell(number(h, ends[0], COUNT_BITS // 4).cast("int"), number(h, ends[1], 16), number(h, ends[2], CHECK_BITS // 4)),
        )
        return F.when(x == EMPTY, cell(F.lit(0), zero, zero)).otherwise(full)

    tables = F.transform(
        F.split(F.substring_index(text, ":", -1), r"\."),
        lambda t: F.transform(F.regexp_extract_all(t, F.lit(f"{EMPTY}|[A-Za-z0-9+/]{{18}}"), F.lit(0)), part),
    )
    n = F.substring_index(text, ":", 1).cast("int")
    keys = F.lit(None).cast("array<long>")
    return F.struct(n.alias("n"), tables.alias("tables"), keys.alias("keys"))


def likeness_of_written(prints: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, near): the likeness of the written fingerprints in two columns, from nothing else; null where a table does not peel."""
    read = prints.select(a, b, F.transform(F.array(a, b), read_back).alias("read"))
    return read.select(a, b, likeness(F.get("read", F.lit(0)), F.get("read", F.lit(1)))["near"].alias("near"))


def predecessors(ids: DataFrame) -> DataFrame:
    """ids(doc_id, key, n) with before(doc_id, key, n), the document before it; the last is before the first."""
    me = F.struct("doc_id", "key", "n")
    ranged = cut(ids.repartitionByRange("doc_id", "key").withColumn("range", F.spark_partition_id()))
    inside = Window.partitionBy("range").orderBy("doc_id", "key")
    near = ranged.withColumn("before", F.lag(me).over(inside))
    ends = ranged.groupBy("range").agg(F.max(me).alias("last"))
    over = Window.orderBy("range")
    everything = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select(
        F.col("range").alias("r"),
        F.coalesce(F.lag("last").over(over), F.last("last").over(everything)).alias("end_before"),
    )
    return near.join(ends, F.col("range") == F.col("r")).select(
        "doc_id", "key", "n", F.coalesce("before", "end_before").alias("before")
    )


def compare(docs: DataFrame) -> DataFrame:
    """The contract's columns for every row of docs(doc_id, text), and how many groups had to be retried."""
    text = F.coalesce(F.col("text"), F.lit(""))
    whole = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("key"))
    ids = whole.select("doc_id", "key", F.length("text").alias("n")).distinct()
    order = cut(predecessors(ids)).withColumnsRenamed({"doc_id": "id", "key": "k"})
    linked = whole.join(order, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("k")))
    sent = linked.select(
        F.col("before.doc_id").alias("to_id"),
        F.col("before.key").alias("to_key"),
        F.substring("text", F.lit(1), F.floor(F.col("before.n") / 4).cast("int")).alias("piece"),
        digests(F.col("text")).alias("next_keys"),
    ).dropDuplicates(["to_id", "to_key"])
    met = whole.join(sent, F.col("doc_id").eqNullSafe(F.col("to_id")) & (F.col("key") == F.col("to_key")))
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - quarter), F.col("piece"))
    with_keys = met.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2(edited, 256).alias("edited_sha256"),
        digests(F.col("text")).alias("own"),
        digests(edited).alias("other"),
        "next_keys",
    )
    prints = with_keys.select("*", F.transform(F.array("own", "other", "next_keys"), fingerprint).alias("prints"))
    own = F.get("prints", F.lit(0))
    likenesses = F.transform(F.slice("prints", 2, 2), lambda x: likeness(own, x))
    shown = F.transform(F.slice("prints", 1, 2), written)
    near = prints.select("*", likenesses.alias("near"), shown.alias("shown"))
    at = lambda name, i: F.get(name, F.lit(i))
    return near.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        at("shown", 0).alias("fingerprint"),
        at("shown", 1).alias("edited_fingerprint"),
        at("near", 0)["near"].alias("near_edited"),
        at("near", 1)["near"].alias("near_next"),
        at("near", 0)["retried"].alias("retried_edited"),
        at("near", 1)["retried"].alias("retried_next"),
    )


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare(table(spark, sf_dir, "documents"))
