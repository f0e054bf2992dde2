"""Fill-in-middle: texts cut at line ends that are counted and found eight bytes at a time."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewords.llm.common import batches, by_document, read, record, texts, utf8

#: Bytes of texts taken at once; a longer text is taken alone.
CHUNK_BYTES = 1 << 21
#: What stands before prefix, suffix and middle; hundredths of texts that are cut, and of those with the suffix first.
MARKS, RATE, SUFFIX_FIRST, SEED = ("<P>", "<S>", "<M>"), 100, 50, "7"
_LOW, _HIGH = np.uint64(0x7F7F7F7F7F7F7F7F), np.uint64(0x8080808080808080)
_ONE, _SEVEN = np.uint64(1), np.uint64(7)


class Marked:
    """Marked bytes of a text seen as 64-bit words, eight bytes each: a mark is a byte's highest bit."""

    def __init__(self, marks: np.ndarray):
        self.marks = np.append(marks, np.uint64(0))
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(marks), dtype=np.int64)))

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many marked bytes lie before each of these places."""
        word, below = at >> 3, (_ONE << ((at & 7) << 3).astype(np.uint64)) - _ONE
        return self.before[word] + np.bitwise_count(self.marks[word] & below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The place of the marked byte that k others precede: its word by the running counts, then the byte within the word."""
        word = np.searchsorted(self.before, k, "right") - 1
        m, left = self.marks[word], k - self.before[word]
        for step in range(7):
            m = np.where(left > step, m & (m - _ONE), m)
        return (word << 3) + (np.bitwise_count((m & (~m + _ONE)) - _ONE) >> 3)


def words_of(raw: np.ndarray) -> np.ndarray:
    """Bytes as little-endian 64-bit words, zeros after the last."""
    padded = np.zeros(-(-len(raw) // 8) * 8, np.uint8)
    padded[: len(raw)] = raw
    return padded.view("<u8")


def equal_to(x: np.ndarray, byte: int) -> np.ndarray:
    """Marks of the bytes that equal ``byte``: no carry leaves a byte, so none is marked wrongly."""
    x = x ^ np.uint64(byte * 0x0101010101010101)
    return ~(((x & _LOW) + _LOW) | x | _LOW)


def continued(x: np.ndarray) -> np.ndarray:
    """Marks of the bytes that go on with a character: the highest bit set, the next one not."""
    return x & ~(x << _ONE) & _HIGH


def cut(raw: np.ndarray, at: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts that lie end to end, with two draws each: how many lines they have, where in them prefix and middle end, and those places in code points."""
    x = words_of(raw)
    lines, inner = Marked(equal_to(x, 10)), Marked(continued(x))
    first, closed = lines.rank(at[:-1]), lines.rank(at[1:])
    whole = np.zeros(len(at) - 1, bool)  # does the last line end in a line feed, or is there none?
    some = at[1:] > at[:-1]
    whole[some] = raw[at[1:][some] - 1] == 10
    n = closed - first + (some & ~whole)
    units = np.sort(draws % (n + 1)[:, None], axis=1)
    places = np.empty_like(units)
    for side in (0, 1):
        k = units[:, side]
        found = (k > 0) & (k <= closed - first)
        places[:, side] = np.where(k == 0, at[:-1], at[1:])
        places[found, side] = lines.select((first + k - 1)[found]) + 1
    chars = places - at[:-1, None] - (inner.rank(places.ravel()).reshape(-1, 2) - inner.rank(at[:-1])[:, None])
    return n, places - at[:-1, None], chars[:, 0], chars[:, 1] - chars[:, 0]


def _arrange(schema: pa.Schema, marks: tuple[str, str, str]):
    p, s, m = (x.encode() for x in marks)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source, CHUNK_BYTES):
            draws = np.stack([batch.column(c).to_numpy() for c in ("h1", "h2")], axis=1)
            n, ends, prefix, middle = cut(*utf8(batch.column("text")), draws)
            forms, out = batch.column("form").to_pylist(), []
            for text, form, (a, b) in zip(texts(batch), forms, ends.tolist(), strict=True):
                out.append(text if form == "plain" else p + text[:a] + s + text[b:] + m + text[a:b] if form == "psm" else s + text[b:] + p + text[:a] + m + text[a:b])
            plain = np.array([f == "plain" for f in forms], bool)
            yield record(schema, doc_id=batch.column("doc_id"), n=n, form=batch.column("form"), prefix_chars=pa.array(prefix, mask=plain), middle_chars=pa.array(middle, mask=plain), output=pa.array(out, pa.binary()).cast(pa.string()))

    return run


def fill_in_middle(docs: DataFrame, marks: tuple[str, str, str] = MARKS, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: str = SEED) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): each text's parts put in another order.

    A text of n lines (each with its line feed; the last may lack one) is cut before or after lines that two draws of
    its id's SHA-256 name. ``psm``: prefix, suffix, middle, each after its mark; ``spm``: suffix, prefix, middle; ``plain``
    leaves a text as it is: empty ones, those that hold a mark, and those beyond ``rate`` in a hundred. Null texts count
    as empty, null ids as the empty id; equal ids draw alike, so repeated rows stay alike; other columns are dropped;
    an empty table gives no rows. A long text takes about ten times its bytes for the moment.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    draw = {f"h{k + 1}": F.conv(F.substring("digest", 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)}
    text = F.coalesce("text", F.lit(""))
    plain = (text == "") | (F.col("h3") % 100 >= rate)
    for mark in marks:
        plain |= F.contains(text, F.lit(mark))
    form = F.when(plain, "plain").when(F.col("h4") % 100 < suffix_first, "spm").otherwise("psm")
    rows = docs.select("doc_id", "text", digest.alias("digest")).withColumns(draw).select("doc_id", "text", "h1", "h2", form.alias("form"))
    fields, schema = by_document(docs, "n long, form string, prefix_chars long, middle_chars long, output string")
    return rows.mapInArrow(_arrange(schema, marks), fields)


def restore(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made of. Only marked forms hold marks, each once, so they part at them."""
    parts = F.split(output, "|".join(re.escape(m) for m in marks), -1)
    psm, spm = (F.concat(*(F.element_at(parts, k) for k in order)) for order in ((2, 4, 3), (3, 4, 2)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms of all documents, and digests of outputs and of the texts rebuilt from them; see ``fill_in_middle`` for odd rows."""
    made = fill_in_middle(read(spark, sf_dir, "documents"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


OP12_SQL = r"""
WITH lines AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
drawn AS (SELECT doc_id, text, u, len(u) AS n, list_transform([1, 9, 17, 25], lambda k: CAST('0x' || substr(h, k, 8) AS BIGINT)) AS d FROM lines),
cuts AS (SELECT *, least(d[1] % (n + 1), d[2] % (n + 1)) AS a, greatest(d[1] % (n + 1), d[2] % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR d[3] % 100 >= 100 THEN 'plain' WHEN d[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (SELECT doc_id, text, n, form, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN text ELSE p || m || s END) AS restored_sha256
FROM parts
"""
