"""Line dedup by a deletion-neighbourhood join.

Two lines are equal if they are the same but for blanks at their ends.  Two lines of at least
``near_words`` words are near if their words are within one edit, a word replaced, added or left
out, and their marks are the same: digits, operators, brackets and all other ASCII signs, in order,
but for sentence punctuation and quotes at the ends of words.  So lines that differ by a number, a sign or an
operator are never near, and neither are short ones, of which an edit is a large part.

A line's deletion neighbourhood is the line itself and the line without each one of its
words.  Two lines are within the bound exactly if they share a member of their neighbourhoods and
the words left out stand at the same place (a replacement) or one of the two is whole (an addition);
this verifies the distance, as hashes of 128 bits stand for the members.

Emitting the neighbourhood of every line would multiply the corpus by the length of its lines.
So an exact prefilter goes first: by the pigeonhole principle two lines within the bound share one
of two halves, at lengths and places that follow from the lines' lengths.  Each line emits four
hashed halves; only lines that share one with another line's emit their neighbourhoods, and of
these only the members that lack a word of the other half.  Repeats
of the same line are found by its hash and are one line from there on.

A line goes if an earlier one, by document id and then by its place, is equal or near.  Earliest lines are
least values of aggregations that combine before they shuffle, so a variant that very many lines share is one row.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import DENSE, col, free, id_type, made, remove, require, slices, slim, stored, words

NEAR_WORDS = 5
BLANKS = " \t\r\x0b\x0c"
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_AFTER, _BEFORE = re.compile(r"[.,;:!?'\"]+([ \t\r\x0b\x0c]|\Z)"), re.compile(r"(\A|[ \t\r\x0b\x0c])['\"]+")
_NO_MARK = bytes(b for b in range(256) if not 0x21 <= b <= 0x7E or chr(b).isalpha())


def marks(line: str) -> bytes:
    """A line's digits and signs, in order, without sentence punctuation and quotes at the ends of words."""
    return _BEFORE.sub(r"\1", _AFTER.sub(r"\1", line)).encode("utf-8", "surrogatepass").translate(None, _NO_MARK)


def halves(line: list[bytes], mark: bytes = b"") -> list[int]:
    """Hashed halves: two for lines of as many words, two for lines of one word less."""
    n = len(line)
    h, g = n // 2, (n - 1) // 2
    parts = ((n, 0, line[:h]), (n, 1, line[h:]), (n - 1, 0, line[:g]), (n - 1, 1, line[g + 1 :]))
    return [xxhash.xxh3_64_intdigest(b" ".join(part) + b"\0" + mark, (size << 1) | side) for size, side, part in parts]


def _signed(x) -> np.ndarray:
    return np.array(x, np.uint64).view(np.int64)


def _line_rows(batches, near_words: int):
    for batch in slices(batches):
        ids = batch.column(0)
        at, number, hashes, keys = [], [], [], []
        for k, text in enumerate(batch.column(1).to_pylist()):
            if not text:
                continue
            for n, raw in enumerate(text.split("\n")):
                line = words(raw)
                if not line:
                    continue
                own = raw.strip(BLANKS)
                at.append(k)
                number.append(n)
                if len(line) >= near_words:
                    mark = marks(own)
                    hashes.append(xxhash.xxh3_128_digest(b"w" + b" ".join(line) + b"\0" + mark))
                    keys.append(halves(line, mark))
                else:
                    hashes.append(xxhash.xxh3_128_digest(b"r" + own.encode("utf-8", "surrogatepass")))
                    keys.append(None)
        h = np.frombuffer(b"".join(hashes), ">i8").astype(np.int64).reshape(-1, 2)
        flat = pa.array(_signed([x for own in keys if own for x in own]))
        ends = np.concatenate([[0], np.cumsum([4 if own else 0 for own in keys])]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [ids.take(pa.array(at, pa.int64())), pa.array(number, pa.int32()), pa.array(h[:, 0]), pa.array(h[:, 1]), pa.ListArray.from_arrays(pa.array(ends), flat)],
            ["doc_id", "line", "h0", "h1", "keys"],
        )


def neighbourhood(line: list[bytes], mark: bytes = b"") -> np.ndarray:
    """128-bit hashes of the line and of the line without each one of its words, as n + 1 rows of two numbers."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, line), np.uint64, len(line))
    n, out, seal = len(h), np.empty((len(h) + 1, 2), np.uint64), xxhash.xxh3_128_intdigest(mark)
    with np.errstate(over="ignore"):
        for c, base in enumerate(_MIX):
            own = h if c == 0 else (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            power = np.cumprod(np.full(n, base, np.uint64))
            here = np.concatenate([[np.uint64(0)], np.cumsum(own * power)])
            left = np.concatenate([[np.uint64(0)], np.cumsum(own[1:] * power[:-1])])
            out[0, c] = here[n] + np.uint64(n) * np.uint64(0xD6E8FEB86659FD93)
            out[1:, c] = here[:n] + (left[n - 1] - left) + np.uint64(n - 1) * np.uint64(0xD6E8FEB86659FD93)
            out[:, c] += np.uint64((seal >> 64 * c) & 0xFFFFFFFFFFFFFFFF)
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return out


def _variants(batches):
    """Members of the neighbourhoods of chosen lines, each given as twice its number and the side of the half that it shares."""
    for batch in slices(batches, 64):
        docs, lines, places, hashes, held = [], [], [], [], 0

        def out():
            h = np.concatenate(hashes).view(np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), pa.array(np.concatenate(places).astype(np.int32)), batch.column(0).take(pa.array(np.concatenate(docs))), pa.array(np.concatenate(lines).astype(np.int32))],
                ["v0", "v1", "place", "doc_id", "line"],
            )

        for k, (text, chosen) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
            all_lines, sides = text.split("\n"), {}
            for c in chosen:
                sides[c >> 1] = sides.get(c >> 1, 0) | 1 << (c & 1)
            for number, side in sorted(sides.items()):
                line = words(all_lines[number])
                n, g = len(line), (len(line) - 1) // 2
                v = neighbourhood(line, marks(all_lines[number].strip(BLANKS)))
                lo, hi = 0 if side & 2 else g, n if side & 1 else g + 1
                hashes += [v[:1], v[1 + lo : 1 + hi]]
                places += [np.array([-1]), np.arange(lo, hi)]
                docs.append(np.full(1 + hi - lo, k))
                lines.append(np.full(1 + hi - lo, number))
                held += 1 + hi - lo
            if held > 200_000:
                yield out()
                docs, lines, places, hashes, held = [], [], [], [], 0
        if held:
            yield out()


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near_words: int = NEAR_WORDS) -> DataFrame:
    """``(doc_id, line, first_doc, first_line)`` for each line with an earlier equal or near one: the earliest such.

    Lines are what newlines part, counted from 0.  Lines without a letter or digit are left alone; all others of
    any length are held against equal ones, those of ``near_words`` words or more against near ones too, where letters' case,
    blanks and sentence punctuation don't count.  Rows with a NULL id or text, and empty texts, have no result.  Rows
    that repeat an id and text count once; if an id has several texts, the text that sorts first counts.  Ids keep
    their type.  An empty table gives an empty one; texts and lines of any length are read whole.
    Other columns are ignored, whatever their names.
    """
    spark, before = docs.sparkSession, len(made())
    base = slim(docs, id_col, text_col).where("doc_id IS NOT NULL AND text IS NOT NULL")
    if _repeated_ids(base):
        base = stored(base.groupBy("doc_id").agg(F.min("text").alias("text")), "lines-docs")
    span = f"doc_id {id_type(docs, id_col)}, line int"
    rows = stored(base.mapInArrow(lambda b: _line_rows(b, near_words), f"{span}, h0 long, h1 long, keys array<long>"), "lines")
    firsts = stored(
        rows.groupBy("h0", "h1").agg(F.min(F.struct("doc_id", "line", "keys")).alias("own"), F.count("*").alias("n")),
        "lines-firsts",
    )
    half = firsts.select(F.posexplode("own.keys").alias("k", "key"), "own.doc_id", "own.line").select("key", (F.col("k") % 2).alias("side"), "doc_id", "line")
    shared = half.groupBy("key").count().where("count > 1").select("key")
    chosen = half.join(shared, "key").groupBy("doc_id").agg(F.collect_set(F.col("line") * 2 + F.col("side")).alias("chosen"))
    variants = stored(
        base.join(chosen.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "chosen")
        .mapInArrow(_variants, f"v0 long, v1 long, place int, {span}"),
        "lines-variants",
    )
    me = F.struct("doc_id", "line")
    # A whole line (place -1) is near all that share the variant, the others are near it and those of their own place.
    heads = variants.groupBy("v0", "v1", "place").agg(F.min(me).alias("head"), F.count("*").alias("n")).repartition("v0", "v1")
    of = heads.groupBy("v0", "v1").agg(
        F.min(F.when(F.col("place") == -1, F.col("head"))).alias("full"), F.min(F.when(F.col("place") >= 0, F.col("head"))).alias("part"), F.sum("n").alias("all")
    )
    first = F.when(F.col("place") == -1, F.col("part")).otherwise(F.least("full", "head"))
    found = heads.join(of.where("all > 1"), ["v0", "v1"]).select("v0", "v1", "place", first.alias("first"), "head", "n").where("first < head OR n > 1 AND first = head")
    near = stored(
        variants.join(found.select("v0", "v1", "place", "first"), ["v0", "v1", "place"])
        .select(me.alias("own"), "first").where("first < own")
        .groupBy("own").agg(F.min("first").alias("first")),
        "lines-near",
    )
    remove(spark, [p for p in made()[before:] if "/lines-variants-" in p])
    own = F.struct("own.doc_id", "own.line")
    found = (
        firsts.select("h0", "h1", own.alias("own"), "n").join(near, "own", "left").where("n > 1 OR first IS NOT NULL")
        .select("h0", "h1", F.least("own", "first").alias("first"))
    )
    return (
        rows.select("h0", "h1", "doc_id", "line").join(found, ["h0", "h1"])
        .where(me > F.col("first"))
        .select("doc_id", "line", F.col("first.doc_id").alias("first_doc"), F.col("first.line").alias("first_line"))
    )


def _repeated_ids(base: DataFrame) -> bool:
    return bool(base.groupBy("doc_id").count().where("count > 1").limit(1).count())


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the lines of :func:`repeated_lines`; columns and their order are unchanged.

    A document of which nothing but blank is left goes, as it was a copy line by line.  Documents
    that lose no line are unchanged, those of NULL ids or texts and empty ones too.  Of the rows of
    an id with several texts, those lose lines that are equal to the text that was looked at.
    A column ``n_chars`` isn't updated here.
    """
    name, gone, first_id, first_text, kept = free(docs, "id_", "gone", "first_id", "first_text", "kept")
    lost = repeated_lines(docs, id_col, text_col, **options).groupBy(F.col("doc_id").alias(name)).agg(F.collect_set("line").alias(gone))
    key, text = col(docs, id_col), col(docs, text_col).cast("string")
    both = docs.join(lost.hint("shuffle_hash"), key == lost[name], "left")
    now = F.col(gone)
    if _repeated_ids(docs.select(key.alias("doc_id")).where("doc_id IS NOT NULL")):
        first = docs.groupBy(key.alias(first_id)).agg(F.min(text).alias(first_text))
        both = both.join(first, key == first[first_id], "left")
        now = F.when(F.col(first_text) == text, F.col(gone))
    lines = F.split(text, "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    both = both.withColumn(gone, now)
    both = both.withColumn(kept, F.when(F.col(gone).isNull(), text).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")))
    both = both.where(F.col(gone).isNull() | F.col(kept).rlike("\\S"))
    return both.select(*[F.col(kept).alias(c) if c == text_col else col(docs, c).alias(c) for c in docs.columns])


def _class(a: int, b: int) -> str:
    return f"\\x{{{a:X}}}-\\x{{{b:X}}}"


_BLANK = "[ \\t\\r\\x0B\\f]"
_SIGNS = f"regexp_replace(regexp_replace(own, '[.,;:!?''\"]+({_BLANK}|$)', '\\1', 'g'), '(^|{_BLANK})[''\"]+', '\\1', 'g')"

#: The registered query on a table ``documents`` whose ids are distinct.
ORACLE_SQL = rf"""
WITH raw AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents
  WHERE doc_id IS NOT NULL AND text <> ''
), lines AS (
  SELECT doc_id, line::INTEGER AS line, regexp_replace(t, '^{_BLANK}+|{_BLANK}+$', '', 'g') AS own,
    list_filter(string_split_regex(regexp_replace(regexp_replace(lower(t), '([{"".join(_class(a, b) for a, b in DENSE)}])', ' \1 ', 'g'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' +'), lambda x: x <> '') AS w FROM raw
), long AS (
  SELECT doc_id, line, w, mark, CASE WHEN len(w) < {NEAR_WORDS} THEN 'r' || own ELSE 'w' || array_to_string(w, ' ') || chr(10) || mark END AS own
  FROM (SELECT *, regexp_replace({_SIGNS}, '[^\x21-\x40\x5B-\x60\x7B-\x7E]+', '', 'g') AS mark FROM lines WHERE len(w) > 0)
), firsts AS (
  SELECT own, any_value(w) AS w, any_value(mark) AS mark, min((doc_id, line)) AS first FROM long GROUP BY own
), variants AS (
  SELECT own, first, -1 AS place, array_to_string(w, ' ') || chr(10) || mark AS v FROM firsts WHERE len(w) >= {NEAR_WORDS}
  UNION ALL
  SELECT own, first, place, array_to_string(list_concat(w[1:place], w[place + 2:]), ' ') || chr(10) || mark
  FROM (SELECT *, unnest(range(len(w))) AS place FROM firsts WHERE len(w) >= {NEAR_WORDS})
), near AS (
  SELECT a.own, min(b.first) AS first FROM variants a JOIN variants b
  ON a.v = b.v AND (a.place = b.place OR a.place = -1 OR b.place = -1) AND b.first < a.first GROUP BY a.own
), found AS (
  SELECT l.doc_id, l.line, CASE WHEN n.first < f.first THEN n.first ELSE f.first END AS first
  FROM long l JOIN firsts f USING (own) LEFT JOIN near n USING (own)
)
SELECT doc_id, line, first[1] AS first_doc, first[2] AS first_line FROM found WHERE (doc_id, line) > first
"""
