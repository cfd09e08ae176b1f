"""Operator 3, line dedup by winnowing over line hashes, in DataFrame functions only.

A text is cut into units of at most UNIT_WORDS words. A unit ends with its line or with a sentence; where neither ends
within UNIT_WORDS words, it ends with the first word of CUT_CHARS characters after LEAST_CUT others, or else after
UNIT_WORDS words. So long sentences are cut by their content, and a passage repeated at another offset of a long line
soon falls into the same units again.

Of every WINDOW consecutive units the least hash is selected (the rightmost of equals). Two texts that share a run of
WINDOW units therefore share a selected fingerprint, which is all that has to be grouped: roughly half the units, and
each only with the windows around it. Fingerprints that occur once are dropped. The windows around the others are the
possible extensions of a match to both sides: a window is a repeat if the same units occurred earlier, in order of
(doc_id, text hash, position). Every unit of a repeat is deleted. Overlapping repeats make a maximal repeated run, and
each deleted unit equals a unit of an earlier run, so one copy of everything stays. Windows of fewer than LEAST_WORDS
words never count, as strings of one-word sentences repeat by chance. Besides, a whole line of LEAST_WORDS or more
words that equals an earlier one, but for white space around its units, goes whatever its neighbours are.

A window is told by two digests of 64 bits, its fingerprint and the hash of its units' hashes, a line by the hash of its
units' hashes and one of their texts, so a chance agreement of one digest deletes nothing. Nothing is paired: fingerprints, windows and lines are
counted and joined to their first place only, so a line that is in every document costs as many rows as it has
occurrences.

Edge cases: null text stays null with 0 units; empty text has 0 units; texts of fewer than WINDOW units lose whole
lines at most; rows of equal doc_id and text are the same document and keep or lose the same units; null doc_id sorts
first; an empty table gives no rows; other columns are passed through by deduplicate(). White space before the first
unit stays; a deleted unit takes the white space after it along.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.llm import passages
from ledgerlark.llm.secrets import let, running_totals
from ledgerlark.llm.shared import SPACE, WORD, cut, fresh_path, remove, table

UNIT_WORDS = 12
CUT_CHARS = 4
LEAST_CUT = 2
WINDOW = 3
LEAST_WORDS = 6

_WORD = r"[^ \t\n\x0B\f\r]"
_BLANK = r"[ \t\x0B\f\r]"  # white space that ends no line
_SPACE = r"[ \t\n\x0B\f\r]"
#: A word that ends neither its line nor a sentence, and the white space behind. What was once matched is never given
#: back, which spares the matcher its way back through every word.
_ON = rf"{_WORD}++(?<![.!?]){_BLANK}++(?={_WORD})"
_END = rf"{_WORD}++(?:(?<=[.!?])|(?={_BLANK}*+(?:\n|\z))){_SPACE}*+"
_CUT = rf"{_WORD}{{{CUT_CHARS}}}(?<![.!?]){_BLANK}++(?={_WORD})"
UNIT = (
    rf"(?:{_ON}){{0,{UNIT_WORDS - 1}}}+{_END}|(?:{_ON}){{{LEAST_CUT},{UNIT_WORDS - 2}}}?{_CUT}|(?:{_ON}){{{UNIT_WORDS}}}"
)
#: A line that is not blank and all white space behind it: so many whole units.
LINE = r"\S[^\n]*+(?:\n\s*+)?+"
LEAD = rf"^[{SPACE}]*"


def units_of(text: Column) -> Column:
    # Java knows the two classes by shorter names for which it has faster tests.
    pattern = UNIT.replace(_WORD, r"\S").replace(_SPACE, r"\s")
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))


def bare(unit: Column) -> Column:
    return F.rtrim(unit, F.lit(passages.BLANK))


def described(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, text_key, n_units, prints, lines) for every row of docs(doc_id, text).

    prints: each selected fingerprint, the first window `at` that it is the least of, and the hash of that window and of
    those behind that it is the least of as well. lines: two digests of each line, its first unit and number of units.
    """

    def windows(hashes: Column) -> Column:
        """Where the rightmost of the least hashes stands in each window, the least hash and the window's."""
        count = F.greatest(F.size(hashes) - window + 1, F.lit(0))

        def of(z: Column, i: Column) -> Column:
            h = [z[f"h{k}"] for k in range(window)]
            least = F.least(*h) if window > 1 else h[0]
            back = F.lit(0)
            # The last that none before it is under is the rightmost least.
            for k in range(1, window):
                back = F.when(reduce(and_, (h[k] <= h[j] for j in reversed(range(k)))), F.lit(k)).otherwise(back)
            return F.struct((i + back).alias("chosen"), least.alias("print"), F.xxhash64(*h).alias("run"))

        return F.transform(F.arrays_zip(*(F.slice(hashes, k + 1, count).alias(f"h{k}") for k in range(window))), of)

    def selected(ws: Column) -> Column:
        """Windows of one choice are neighbours."""

        def of(w: Column, i: Column) -> Column:
            runs = [w["run"]]
            for k in range(1, window):
                after = F.get(ws, i + k)
                runs.append(F.when(after["chosen"] == w["chosen"], after["run"]))
            first = ~F.get(ws, i - 1)["chosen"].eqNullSafe(w["chosen"])
            named = [r.alias(f"r{k}") for k, r in enumerate(runs)]
            return F.when(first, F.struct(w["print"].alias("print"), i.alias("at"), *named))

        return F.filter(F.transform(ws, of), lambda x: x.isNotNull())

    def of_lines(units: Column, bares: Column, hashes: Column) -> Column:
        """Lines are runs of units of which only the last holds the end of a line."""
        last = F.size(units) - 1
        ends = F.filter(F.sequence(F.lit(0), last), lambda i: (i == last) | F.contains(F.get(units, i), F.lit("\n")))
        begins = F.when(last >= 0, F.concat(F.array(F.lit(-1)), ends)).otherwise(F.array(F.lit(-1)))

        def of(ends: Column) -> Column:
            def line(end: Column, i: Column) -> Column:
                at, n = F.get(ends, i) + 1, end - F.get(ends, i)
                return F.struct(
                    F.xxhash64(F.slice(hashes, at + 1, n)).alias("print"),
                    F.xxhash64(F.lit(7), F.slice(bares, at + 1, n)).alias("run"),
                    at.alias("at"),
                    n.alias("n"),
                )

            return F.transform(F.slice(ends, F.lit(2), F.size(ends)), line)

        return let(begins, of)

    def found(units: Column, bares: Column, hashes: Column) -> Column:
        return F.struct(
            F.size(units).alias("n_units"),
            let(windows(hashes), selected).alias("prints"),
            of_lines(units, bares, hashes).alias("lines"),
        )

    of_text = let(
        units_of(F.col("text")),
        lambda us: let(
            F.transform(us, bare), lambda bs: let(F.transform(bs, lambda u: F.xxhash64(u)), lambda hs: found(us, bs, hs))
        ),
    )
    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), of_text.alias("t")).select("doc_id", "text_key", "t.*")


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text_key, n_units, begins, starts, spans): for each text, where its lines begin, and where windows and
    lines (at, n) begin that occurred earlier.
    """
    spark = docs.sparkSession
    # Written once, as it is counted and joined; only the columns asked for are read again.
    path = fresh_path(spark, "units")
    described(docs, window).write.parquet(path)
    found = spark.read.parquet(path)
    prints = found.select(F.explode("prints.print").alias("p"))
    shared = cut(prints.groupBy("p").agg(F.count("*").alias("seen")).where("seen > 1").select("p"))
    each = found.select("doc_id", "text_key", F.explode("prints").alias("x")).select("doc_id", "text_key", "x.*")
    matched = each.join(shared, F.col("print") == F.col("p"), "left_semi")
    around = F.array(*(F.struct((F.col("at") + k).alias("at"), F.col(f"r{k}").alias("run")) for k in range(window)))
    windows = matched.select("doc_id", "text_key", "print", F.explode(around).alias("w")).where("w.run is not null")
    windows = cut(windows.select("doc_id", "text_key", "print", "w.*"))
    lines = cut(found.select("doc_id", "text_key", F.explode("lines").alias("x")).select("doc_id", "text_key", "x.*"))
    sizes = cut(found.select("doc_id", "text_key", "n_units", F.col("lines.at").alias("begins")).distinct())
    remove(spark, path)  # windows, lines and sizes stand on checkpoints of their own
    passages.release(spark)
    starts = cut(passages.later(windows).select("doc_id", "text_key", "at"))
    del each, matched, windows, shared
    passages.release(spark)
    spans = passages.later(lines).select("doc_id", "text_key", F.struct("at", "n").alias("span"))
    both = sizes.unionByName(starts, allowMissingColumns=True).unionByName(spans, allowMissingColumns=True)
    found = both.groupBy("doc_id", "text_key").agg(
        F.max("n_units").alias("n_units"),
        F.first("begins", ignorenulls=True).alias("begins"),
        F.collect_set("at").alias("starts"),
        F.collect_set("span").alias("spans"),
    )
    found = cut(found)
    del starts, spans, lines, sizes, both
    passages.release(spark)
    return found


def units_where_needed(text: Column, window: int, least_words: int) -> Column:
    """The units of a text, of which only lines are cut where a window of starts may delete a part.

    Any other line is deleted or kept whole, so it stands as its first unit, and its other units are empty. What starts and
    spans delete is the same, as are their words and the text that is left.
    """
    many = rf"^(?:\S++\s++){{{max(0, least_words - 1)}}}\S"
    begins, n_units = F.col("begins"), F.col("n_units")

    def reach(starts: Column) -> Column:
        return F.flatten(F.transform(starts, lambda s: F.sequence(s, s + (window - 1))))

    def own(i: Column) -> Column:
        """The units of line i."""
        return F.sequence(F.get(begins, i), F.coalesce(F.get(begins, i + 1), n_units) - 1)

    def cut_lines(lines: Column) -> Column:
        whole = F.filter("spans", lambda s: F.get(lines, F.array_position(begins, s["at"]).cast("int") - 1).rlike(many))
        by_line = F.flatten(F.transform(whole, lambda s: F.sequence(s["at"], s["at"] + s["n"] - 1)))
        # Units that only windows can delete; the windows that hold one, and all units of those, have to be known.
        open_units = F.array_except(reach(F.col("starts")), by_line)
        hold = F.flatten(F.transform(open_units, lambda u: F.sequence(u - (window - 1), u)))
        return let(F.array_distinct(reach(F.array_intersect(F.col("starts"), hold))), lambda known: cut_by(lines, known))

    def cut_by(lines: Column, known: Column) -> Column:
        def one(line: Column, i: Column) -> Column:
            as_one = F.transform(own(i), lambda _, k: F.when(k == 0, line).otherwise(F.lit("")))
            return F.when((F.size(known) > 0) & F.arrays_overlap(known, own(i)), units_of(line)).otherwise(as_one)

        return F.flatten(F.transform(lines, one))

    return let(F.regexp_extract_all(text, F.lit(LINE), F.lit(0)), cut_lines)


def units_gone(units: Column, window: int, least_words: int) -> Column:
    """The units that those of starts and spans delete that have enough words."""
    many = rf"^(?:\S++\s++){{{max(0, least_words - 1)}}}\S"

    def enough(at: Column, n: Column) -> Column:
        return F.array_join(F.slice(units, at + 1, n), "").rlike(many)

    starts = F.filter("starts", lambda s: enough(s, F.lit(window)))
    # Of a line, so many units are looked at as have the words for sure.
    spans = F.filter("spans", lambda s: enough(s["at"], F.least(s["n"], F.lit(least_words))))
    by_window = F.flatten(F.transform(starts, lambda s: F.sequence(s, s + (window - 1))))
    by_line = F.flatten(F.transform(spans, lambda s: F.sequence(s["at"], s["at"] + s["n"] - 1)))
    return F.array_distinct(F.concat(by_window, by_line))


def joined_to(docs: DataFrame, found: DataFrame) -> DataFrame:
    """row, with all columns of docs, and what found(doc_id, text_key, ..) has of it."""
    lean = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    found = found.withColumnsRenamed({"doc_id": "of", "text_key": "key"})
    same = F.col("row.doc_id").eqNullSafe(F.col("of")) & (F.xxhash64("row.text") == F.col("key"))
    return lean.join(found, same, "left")


def deduplicate(docs: DataFrame, window: int = WINDOW, least_words: int = LEAST_WORDS) -> DataFrame:
    """(row, n_units, n_removed, text): row holds all columns of docs, text has later repeated runs deleted."""
    joined = joined_to(docs, repeats(docs.select("doc_id", "text"), window))
    text = F.col("row.text")

    def cleaned(units: Column, gone: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(units) - 1), gone)
        lead = F.when(F.ltrim(F.substring(text, 1, 1), F.lit(passages.BLANK)) == "", F.regexp_extract(text, LEAD, 0)).otherwise("")
        kept = F.concat(lead, F.array_join(F.transform(left, lambda i: F.get(units, i)), ""))
        return F.struct(F.size(gone).alias("n"), F.when(F.size(gone) == 0, text).otherwise(kept).alias("text"))

    with_units = let(
        units_where_needed(text, window, least_words),
        lambda us: let(units_gone(us, window, least_words), lambda gone: cleaned(us, gone)),
    )
    as_it_is = F.struct(F.lit(0).alias("n"), text.alias("text"))
    done = F.when(F.size("starts") + F.size("spans") > 0, with_units).otherwise(as_it_is)
    return joined.select("row", "n_units", done.alias("done")).select(
        "row", "n_units", F.col("done.n").alias("n_removed"), F.col("done.text").alias("text")
    )


def deduplicate_whole(docs: DataFrame) -> DataFrame:
    """(row, n_removed, text): as deduplicate(), but text also has the spans of passages.repeated_runs() deleted.

    n_removed counts words. Everything is found in the texts as they come, so no deletion hides another.
    """
    read = docs.select("doc_id", "text")
    runs = passages.repeated_runs(read).groupBy("doc_id", "text_key").agg(F.collect_set("span").alias("runs"))
    runs = cut(runs)
    passages.release(docs.sparkSession)
    units = repeats(read).where(F.size("starts") + F.size("spans") > 0).drop("n_units", "begins")
    both = units.unionByName(runs, allowMissingColumns=True)
    cutting = both.groupBy("doc_id", "text_key").agg(
        *(F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "spans", "runs"))
    )
    joined = joined_to(docs, cutting)
    text = F.col("row.text")
    nothing = F.array().cast("array<int>")
    by_run = F.flatten(F.transform("runs", lambda s: F.sequence(s["at"], s["at"] + s["n"] - 1)))

    def of_units(units: Column) -> Column:
        """The places of the words of deleted units."""
        counts = F.transform(units, lambda u: F.size(F.regexp_extract_all(u, F.lit(WORD), F.lit(0))))
        return let(
            counts,
            lambda ns: let(
                running_totals(ns),
                lambda ahead: F.flatten(
                    F.transform(
                        units_gone(units, WINDOW, LEAST_WORDS),
                        lambda u: F.sequence(F.get(ahead, u), F.get(ahead, u) + F.get(ns, u) - 1),
                    )
                ),
            ),
        )

    any_units = F.size("starts") + F.size("spans") > 0
    by_unit = F.when(any_units, let(units_of(text), of_units)).otherwise(nothing)
    gone = F.array_distinct(F.concat(by_run, by_unit))
    words = F.regexp_extract_all(text, F.lit(rf"{WORD}[{SPACE}]*"), F.lit(0))
    kept = let(
        words,
        lambda ws: F.array_join(
            F.transform(F.array_except(F.sequence(F.lit(0), F.size(ws) - 1), F.col("gone")), lambda i: F.get(ws, i)), ""
        ),
    )
    marked = joined.select("row", F.when(F.col("key").isNotNull(), gone).otherwise(nothing).alias("gone"))
    return marked.select(
        "row",
        F.size("gone").alias("n_removed"),
        F.when(F.size("gone") == 0, text).otherwise(F.concat(F.regexp_extract(text, LEAD, 0), kept)).alias("text"),
    )


#: The same units in syntax that DuckDB knows.
_BLANK_SQL = r"[\x20\x09\x0B-\x0D]"
_ON_SQL = rf"[^{SPACE}]*[^{SPACE}.!?]{_BLANK_SQL}+"
_UNIT_SQL = (
    rf"(?:{_ON_SQL}){{0,{UNIT_WORDS - 1}}}(?:[^{SPACE}]*[.!?](?:[{SPACE}]+|$)|[^{SPACE}]+{_BLANK_SQL}*(?:\n[{SPACE}]*|$))"
    rf"|(?:{_ON_SQL}){{{LEAST_CUT},{UNIT_WORDS - 2}}}?[^{SPACE}]{{{CUT_CHARS - 1}}}[^{SPACE}.!?]{_BLANK_SQL}+"
    rf"|(?:{_ON_SQL}){{{UNIT_WORDS}}}"
)
ORACLE = f"""
with t as (select doc_id, text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) as blank from documents),
p as (select doc_id, text, regexp_extract_all(text, '{_UNIT_SQL}') as pieces from t),
i as (select doc_id, unnest(string_split(text, chr(10))) as line, blank,
  generate_subscripts(string_split(text, chr(10)), 1) as nth from t),
n as (select *, regexp_extract_all(line, '{_UNIT_SQL}') as units from i),
l as (select doc_id, nth, units, blank, array_to_string([rtrim(x, blank) for x in units], chr(1)) as line from n),
a as (select *, coalesce(sum(len(units)) over (
  partition by doc_id order by nth rows between unbounded preceding and 1 preceding), 0)::bigint as ahead from l),
u as (select doc_id, ahead + unnest(generate_series(1, len(units))) as unit, rtrim(unnest(units), blank) as bare from a),
w as (select doc_id, unit, array_to_string(list(bare) over three, chr(1)) as run, count(*) over three as units
  from u window three as (partition by doc_id order by unit rows between current row and {WINDOW - 1} following)),
c as (select * from w where units = {WINDOW} and len(regexp_extract_all(run, '[^{SPACE}\\x01]+')) >= {LEAST_WORDS}),
r as (select doc_id, unit, row_number() over (partition by run order by doc_id, unit) as nth from c),
m as (select *, row_number() over (partition by line order by doc_id, nth) as again from a
  where len(regexp_extract_all(line, '[^{SPACE}\\x01]+')) >= {LEAST_WORDS}),
gone as (select doc_id, unnest(generate_series(unit, unit + {WINDOW - 1})) as unit from r where nth > 1
  union select doc_id, unnest(generate_series(ahead + 1, ahead + len(units))) from m where again > 1),
k as (select doc_id, list(unit) as gone from gone group by doc_id)
select p.doc_id, cast(coalesce(len(pieces), 0) as bigint) as n_units, cast(coalesce(len(gone), 0) as bigint) as n_removed,
  case when gone is null then text else regexp_extract(text, '{LEAD}') || coalesce(array_to_string(
    [pieces[i] for i in generate_series(1, len(pieces)) if not list_contains(gone, i)], ''), '') end as text
from p left join k on p.doc_id = k.doc_id
"""


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        F.col("row.doc_id").alias("doc_id"),
        F.col("n_units").cast("long").alias("n_units"),
        F.col("n_removed").cast("long").alias("n_removed"),
        "text",
    )
