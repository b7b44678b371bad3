"""Fill-in-the-middle training texts, cut at units of the text by a parallel automaton scan.

A unit is a run of ASCII letters or any other single character. A deterministic
automaton over UTF-8 bytes finds where units begin, and whether a marker of the
output stands in the text. Texts are cut into strips of STRIP bytes; all strips
are run in step from every state, which gives each strip a function from entry
to exit state and, for each entry state, the number of units that begin in it.
These functions compose associatively: a scan by doubling gives each strip its
entry state and the units before it, and only the strip that holds a cut is run
again to find the byte. Documents longer than CHUNK bytes are dealt out to
tasks chunk by chunk in the same way: the tasks return the chunks' functions,
these are composed for each document, and a cut is looked for in its chunk only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes run in step, bytes of one task's share of a long document, bytes of text worked on at once.
STRIP, CHUNK, PIECE = 256, 1 << 16, 1 << 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 documents, those that stay plain, and of the others those with the suffix first.
PLAIN_PERCENT, SUFFIX_FIRST_PERCENT = 10, 20

#: States: outside a run of letters, inside one, after ``<``, after ``<`` and the letter of a marker (inside a run).
_OUTSIDE, _INSIDE, _OPEN, _NAMED = range(4)
#: Kinds of bytes; _NONE fills the last strip of a text and changes nothing.
_NONE, _OTHER, _LETTER, _NAME, _OPENER, _CLOSER, _CONTINUED = range(7)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = _LETTER
_KIND[[ord(x[1]) for x in (PREFIX, SUFFIX, MIDDLE)]] = _NAME
_KIND[ord("<")], _KIND[ord(">")] = _OPENER, _CLOSER
_KIND[0x80:0xC0] = _CONTINUED
#: A step of the automaton, as one number: next state, units begun << 2, markers ended << 34.
_UNIT, _MARKER = 1 << 2, 1 << 34


def _steps() -> np.ndarray:
    out = np.zeros((7, 4), np.int64)
    out[_NONE] = range(4)
    out[_OTHER] = _OUTSIDE + _UNIT
    out[_CONTINUED] = _OUTSIDE
    out[_OPENER] = _OPEN + _UNIT
    out[_CLOSER] = _OUTSIDE + _UNIT
    out[_CLOSER, _NAMED] += _MARKER
    out[_LETTER] = out[_NAME] = _INSIDE
    out[_NAME, _OPEN] = _NAMED
    out[_LETTER : _NAME + 1, [_OUTSIDE, _OPEN]] += _UNIT
    return out.ravel()


_STEPS = _steps()


def compose(first: tuple[np.ndarray, np.ndarray], then: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The function of two neighbouring parts of a text, from those of each: (exit state, packed counts) for each entry state, in rows."""
    state, count = first
    return np.take_along_axis(then[0], state, 1), count + np.take_along_axis(then[1], state, 1)


def composed(part: tuple[np.ndarray, np.ndarray], place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's function composed with all rows before it in its text; ``place`` is its number there, from 0."""
    state, count = part[0].copy(), part[1].copy()
    step, longest = 1, int(place.max(initial=0))
    while step <= longest:
        later = np.flatnonzero(place >= step)
        state[later], count[later] = compose((state[later - step], count[later - step]), (state[later], count[later]))
        step *= 2
    return state, count


class Scan:
    """The functions of several texts (or chunks of texts), from the bytes of all of them."""

    def __init__(self, texts: list[bytes]):
        self.size = np.fromiter(map(len, texts), np.int64, len(texts))
        strips = -(-self.size // STRIP)
        self.stop = np.cumsum(strips)
        self.first = self.stop - strips
        self.text = np.repeat(np.arange(len(texts)), strips)
        self.place = np.arange(len(self.text)) - self.first[self.text]
        self.kinds = np.zeros((len(self.text), STRIP), np.uint8)
        flat = self.kinds.ravel()
        data = _KIND[np.frombuffer(b"".join(texts), np.uint8)]
        start = np.cumsum(self.size) - self.size
        flat[np.arange(len(data)) + np.repeat(self.first * STRIP - start, self.size)] = data
        state = np.tile(np.arange(4), (len(self.text), 1))
        count = np.zeros_like(state)
        for kind in np.ascontiguousarray(self.kinds.T).astype(np.int64) * 4:
            step = _STEPS[kind[:, None] + state]
            state = step & 3
            count += step - state
        self.through = composed((state, count), self.place)

    def functions(self) -> tuple[np.ndarray, np.ndarray]:
        """(exit state, packed counts) of each whole text for each entry state."""
        state, count = np.tile(np.arange(4), (len(self.size), 1)), np.zeros((len(self.size), 4), np.int64)
        some = self.size > 0
        state[some], count[some] = self.through[0][self.stop[some] - 1], self.through[1][self.stop[some] - 1]
        return state, count

    def find(self, entry: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """Byte where unit number ``unit`` (from 0) of each text begins, when it is entered in state ``entry``; its size if no such unit begins there."""
        out = self.size.copy()
        if not len(self.text):
            return out
        own = units(self.through[1][np.arange(len(self.text)), entry[self.text]])
        # One rising sequence over all texts: a text's counts start where those of the one before it end.
        total = np.zeros(len(self.size), np.int64)
        some = self.size > 0
        total[some] = own[self.stop[some] - 1]
        base = np.cumsum(total) - total
        asked = np.flatnonzero((unit < total) & (unit >= 0))
        strip = np.searchsorted(own + base[self.text], base[asked] + unit[asked], side="right")
        inner = self.place[strip] > 0
        state = np.where(inner, self.through[0][strip - 1, entry[asked]], entry[asked])
        left = unit[asked] - np.where(inner, own[strip - 1], 0) + 1
        at = np.full(len(asked), -1, np.int64)
        for i, kind in enumerate(self.kinds[strip].T.astype(np.int64) * 4):
            step = _STEPS[kind + state]
            state = step & 3
            left -= units(step)
            at[(at < 0) & (left == 0)] = i
        out[asked] = self.place[strip] * STRIP + at
        return out


def units(packed: np.ndarray) -> np.ndarray:
    return (packed & (_MARKER - 1)) >> 2


def markers(packed: np.ndarray) -> np.ndarray:
    return packed >> 34


def _pieces(column: pa.Array) -> Iterator[list[bytes]]:
    """The texts in lists of at most PIECE bytes, or of one text."""
    held, size = [], 0
    for value in column:
        text = value.as_py() or b""
        if held and size + len(text) > PIECE:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def _draws(doc_id: Column) -> list[Column]:
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _cuts(n: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b = h1 % (n + 1), h2 % (n + 1)
    return np.minimum(a, b), np.maximum(a, b)


_CUT = "struct<n: long, markers: long, low: long, high: long>"


def _short(rows: DataFrame) -> DataFrame:
    """``rows`` with the cuts of texts that are one chunk each."""

    @F.arrow_udf(_CUT)
    def cut(text: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
        found, done = [], 0
        for texts in _pieces(text):
            scan = Scan(texts)
            count = scan.functions()[1][:, _OUTSIDE]
            n, outside = units(count), np.zeros(len(texts), np.int64)
            low, high = _cuts(n, *(h.slice(done, len(texts)).to_numpy(zero_copy_only=False) for h in (h1, h2)))
            found.append((n, markers(count), scan.find(outside, low), scan.find(outside, high)))
            done += len(texts)
        fields = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 4
        return pa.StructArray.from_arrays([pa.array(x) for x in fields], ["n", "markers", "low", "high"])

    return rows.withColumn("cut", cut("bytes", "h1", "h2"))


def _long(rows: DataFrame) -> DataFrame:
    """``rows`` with the cuts of texts of several chunks, each chunk in a task of its own.

    Only the chunks' functions and the cuts are grouped, 100 bytes for each CHUNK
    of text. Equal rows (doc_id and digest of the text) have equal answers.
    """
    keyed = rows.withColumn("name", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).withColumn("digest", F.sha2("bytes", 256))
    starts = F.sequence(F.lit(0).cast("long"), F.octet_length("bytes").cast("long") - 1, F.lit(CHUNK).cast("long"))
    chunks = keyed.select("name", "digest", "h1", "h2", F.posexplode(F.transform(starts, lambda at: F.substring(F.col("bytes"), at.cast("int") + 1, F.lit(CHUNK)))).alias("chunk", "part"))
    chunks = chunks.repartition("name", "digest", "chunk")

    def functions(batches):
        for batch in batches:
            done = 0
            for texts in _pieces(batch.column(5)):
                state, count = Scan(texts).functions()
                rest = [c.slice(done, len(texts)) for c in batch.columns[:5]]
                done += len(texts)
                yield pa.RecordBatch.from_arrays([*rest, pa.array(list(state), pa.list_(pa.int64())), pa.array(list(count), pa.list_(pa.int64()))], names=["name", "digest", "h1", "h2", "chunk", "state", "count"])

    schema = "name string, digest string, h1 long, h2 long, chunk int"
    scanned = chunks.mapInArrow(functions, f"{schema}, state array<long>, count array<long>").dropDuplicates(["name", "digest", "chunk"])

    def locate(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """The chunk of each cut, its entry state, and the unit's number there."""
        pdf = pdf.sort_values("chunk")
        state, count = composed((np.stack(pdf["state"]), np.stack(pdf["count"])), np.arange(len(pdf)))
        through = units(count[:, _OUTSIDE])
        n = through[-1:]
        out = {"name": key[0], "digest": key[1], "n": n, "markers": markers(count[-1:, _OUTSIDE])}
        for side, unit in zip(("low", "high"), _cuts(n, pdf["h1"].to_numpy()[:1], pdf["h2"].to_numpy()[:1]), strict=True):
            chunk = np.minimum(np.searchsorted(through, unit, side="right"), len(pdf) - 1)
            before = chunk > 0
            out |= {f"{side}_chunk": chunk, f"{side}_entry": np.where(before, state[chunk - 1, _OUTSIDE], _OUTSIDE), f"{side}_unit": unit - np.where(before, through[chunk - 1], 0)}
        return pd.DataFrame(out)

    sides = ", ".join(f"{side}_chunk long, {side}_entry long, {side}_unit long" for side in ("low", "high"))
    located = scanned.groupBy("name", "digest").applyInPandas(locate, f"name string, digest string, n long, markers long, {sides}")

    @F.arrow_udf("long")
    def find(part: pa.Array, entry: pa.Array, unit: pa.Array) -> pa.Array:
        found, done = [np.zeros(0, np.int64)], 0
        for texts in _pieces(part):
            found.append(Scan(texts).find(*(x.slice(done, len(texts)).to_numpy(zero_copy_only=False) for x in (entry, unit))))
            done += len(texts)
        return pa.array(np.concatenate(found))

    def place(side: str) -> Column:
        start = F.col(f"{side}_chunk") * CHUNK
        return start + find(F.substring(F.col("bytes"), start.cast("int") + 1, F.lit(CHUNK)), F.col(f"{side}_entry"), F.col(f"{side}_unit"))

    return keyed.join(located, ["name", "digest"]).withColumn("cut", F.struct("n", "markers", place("low").alias("low"), place("high").alias("high"))).select(*rows.columns, "cut")


def fill_in_middle(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of every row.

    ``n`` is the number of units of the whole text. The cuts and the form are
    drawn from the SHA-256 of doc_id, so repeated rows get the same ones; a null
    doc_id draws as an empty number. Null and empty texts, texts in which a
    marker stands, and PLAIN_PERCENT of the rest stay plain (prefix_chars and
    middle_chars are null). An empty table gives no rows. Columns other than
    doc_id and text are not read.
    """
    h1, h2, h3, h4 = _draws(F.col("doc_id"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("bytes"), h1.alias("h1"), h2.alias("h2"))
    cut = _short(rows.where(F.octet_length("bytes") <= CHUNK)).unionByName(_long(rows.where(F.octet_length("bytes") > CHUNK)))
    low, high = F.col("cut.low").cast("int"), F.col("cut.high").cast("int")
    part = lambda start, size: F.substring(F.col("bytes"), start + 1, size).cast("string")
    plain = (F.col("cut.n") == 0) | (F.col("cut.markers") > 0) | (h3 % 100 >= 100 - PLAIN_PERCENT)
    form = F.when(plain, "plain").when(h4 % 100 < SUFFIX_FIRST_PERCENT, "spm").otherwise("psm")
    parts = cut.select("doc_id", F.col("cut.n").alias("n"), form.alias("form"), part(F.lit(0), low).alias("prefix"), part(low, high - low).alias("middle"), part(high, F.octet_length("bytes") - high).alias("suffix"))
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    chars = lambda name: F.when(F.col("form") != "plain", F.char_length(name).cast("long"))
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.concat("prefix", "middle", "suffix"))
    return parts.select("doc_id", "n", "form", chars("prefix").alias("prefix_chars"), chars("middle").alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The original text, from an output and its form alone. No marker stands in the parts, so its first place is the one that was set."""
    second = F.when(form == "psm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX))
    at, end = F.instr(output, second), F.instr(output, F.lit(MIDDLE))
    first = F.substring(output, F.lit(4), at - 4)
    then = F.substring(output, at + 3, end - at - 3)
    middle = F.substring(output, end + 3, F.char_length(output))
    return F.when(form == "plain", output).when(form == "psm", F.concat(first, middle, then)).otherwise(F.concat(then, middle, first))
