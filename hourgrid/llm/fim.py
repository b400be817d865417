"""Fill-in-middle: texts cut in two places, their middles put last.

Cuts fall between units (words, or so many characters of a class). A text is stored as
its maximal runs of one character class, each with the units up to its end; the place of a
cut is the run found by binary search and an offset computed from the run's start.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourgrid.llm.common import byte_slices

#: Marks of prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")


@dataclass(frozen=True)
class CharClass:
    """Code points (inclusive ranges) whose runs make units of ``width`` each, the last of a run
    perhaps shorter; 0: a whole run is one unit. A run that ``joins_next`` has no units of its own
    but begins the first unit of the run after it; at a text's end it is one unit."""

    ranges: tuple[tuple[int, int], ...] = ()
    width: int = 0
    joins_next: bool = False


#: Words with the blanks before them; what no class after the first lists is of the first.
WORDS = (CharClass(), CharClass(((0x09, 0x0D), (0x20, 0x20)), joins_next=True))


@dataclass(frozen=True)
class Runs:
    """Maximal runs of several texts laid end to end: where each begins, its length and width, the
    units up to its end over all texts; ``base`` has the units before each text and at the end."""

    begin: np.ndarray
    length: np.ndarray
    width: np.ndarray
    upto: np.ndarray
    base: np.ndarray

    def units(self) -> np.ndarray:
        return np.diff(self.base)

    def offsets(self, starts: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """Code points before the first ``cuts`` units of each text; ``starts`` are the texts' own."""
        out = np.zeros(len(cuts), np.int64)
        own = np.flatnonzero(cuts > 0)
        want = self.base[own] + cuts[own]
        run = np.searchsorted(self.upto, want)  # the first run that reaches so many units
        before = np.where(run > 0, self.upto[run - 1], 0)
        inside = np.where(self.width[run] > 0, np.minimum((want - before) * self.width[run], self.length[run]), self.length[run])
        out[own] = self.begin[run] + inside - starts[own]
        return out


class RunEncoder:
    """Texts to runs, by a table with the class of every code point."""

    def __init__(self, classes: tuple[CharClass, ...] = WORDS) -> None:
        self.table = np.zeros(0x110000, np.uint8)
        for k, c in enumerate(classes):
            for lo, hi in c.ranges:
                self.table[lo : hi + 1] = k
        self.widths = np.array([c.width for c in classes], np.int64)
        self.joins = np.array([c.joins_next for c in classes])

    def encode(self, texts: list[str]) -> tuple[Runs, np.ndarray]:
        """The runs of ``texts``, and where each text starts (in code points, with the end)."""
        starts = np.cumsum([0, *map(len, texts)])
        kind = self.table[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")]
        edge = np.ones(len(kind), bool)
        edge[1:] = kind[1:] != kind[:-1]
        edge[starts[:-1][starts[:-1] < len(kind)]] = True
        begin = np.flatnonzero(edge)
        length = np.diff(np.r_[begin, len(kind)])
        of = kind[begin]
        width = self.widths[of]
        units = np.where(width > 0, -(-length // np.maximum(width, 1)), 1)
        last = np.isin(begin + length, starts)
        units[self.joins[of] & ~last] = 0
        upto = np.cumsum(units)
        base = np.r_[0, upto][np.searchsorted(begin, starts)]
        return Runs(begin, length, width, upto, base), starts


def _arranged(text: str, form: str, lo: int, hi: int, markers: tuple[str, str, str]) -> str:
    p, s, m = markers
    if form == "psm":
        return "".join((p, text[:lo], s, text[hi:], m, text[lo:hi]))
    return "".join((s, text[hi:], p, text[:lo], m, text[lo:hi])) if form == "spm" else text


def draws(id_col: str, seed: str) -> list[Column]:
    """Four 32-bit numbers from the SHA-256 of seed, colon and id; a null id counts as ''."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = 50, spm: int = 80, seed: str = "42", markers: tuple[str, str, str] = MARKERS, classes: tuple[CharClass, ...] = WORDS, keep_runs: bool = False) -> DataFrame:
    """``rate`` in 100 documents become fill-in-middle, ``spm`` in 100 of these suffix first.

    Returns all columns of ``docs`` but ``text_col`` and, added or replaced: ``n`` (long, the
    units), ``form`` (plain, psm or spm), ``prefix_chars`` and ``middle_chars`` (long, code points;
    null if plain) and ``output``, the text: ``<P>`` prefix ``<S>`` suffix ``<M>`` middle, or ``<S>``
    suffix ``<P>`` prefix ``<M>`` middle, or the plain text. With ``keep_runs`` also ``run_chars``
    and ``run_units`` (arrays of long), code points and units up to the end of each run, from
    which the same text can be cut again.

    Cuts and form come from a hash of the id alone, so any run and order of rows gives the
    same. No shuffle; a task holds about 4 MB of texts, or one longer text, and six times
    that for its runs.

    Defined cases: null counts as empty, an empty text is plain with no units; a text that holds
    a marker is plain; a text of blanks is one unit; a very long text is cut as a whole; repeated
    rows stay and get equal results; an empty table gives an empty table; a null id draws as ''.
    """
    if any(not m or any(m[:i] == m[-i:] for i in range(1, len(m))) for m in markers) or len({*markers}) < 3:
        raise ValueError("markers must differ, and none may end as it begins: cut texts could not be told from them")
    added = {"n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "output": "string"}
    added |= {"run_chars": "array<long>", "run_units": "array<long>"} if keep_runs else {}
    rest = [c for c in docs.columns if c != text_col and c not in {*added, "run_chars", "run_units"}]
    schema = docs.select(*rest, *[F.lit(None).cast(t).alias(c) for c, t in added.items()]).schema
    k = len(rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = RunEncoder(classes)
        for batch in batches:
            for part in byte_slices(batch, k + 4):
                texts = [t or "" for t in part.column(k + 4).to_pylist()]
                h1, h2, h3, h4 = (np.asarray(part.column(k + i)) for i in range(4))
                runs, starts = encoder.encode(texts)
                n = runs.units()
                a, b = h1 % (n + 1), h2 % (n + 1)
                lo, hi = (runs.offsets(starts[:-1], cut) for cut in (np.minimum(a, b), np.maximum(a, b)))
                plain = np.array([not t or any(m in t for m in markers) for t in texts], bool) | (h3 % 100 >= rate)
                form = np.where(plain, "plain", np.where(h4 % 100 < spm, "spm", "psm"))
                made = [_arranged(t, f, x, y, markers) for t, f, x, y in zip(texts, form.tolist(), lo.tolist(), hi.tolist(), strict=True)]
                new = [pa.array(n, pa.int64()), pa.array(form.tolist(), pa.string()), pa.array(lo, pa.int64(), mask=plain), pa.array(hi - lo, pa.int64(), mask=plain), pa.array(made, pa.string())]
                if keep_runs:
                    at = np.searchsorted(runs.begin, starts)
                    of = np.repeat(np.arange(len(texts)), np.diff(at))
                    new += [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(v, pa.int64())) for v in (runs.begin + runs.length - starts[of], runs.upto - runs.base[of])]
                yield pa.RecordBatch.from_arrays([*part.columns[:k], *new], [*rest, *added])

    drawn = [h.alias(f"__h{i}") for i, h in enumerate(draws(id_col, seed))]
    return docs.select(*rest, *drawn, text_col).mapInArrow(run, schema)


def restored_text(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that ``output`` was made of, from itself and its ``form`` alone. Texts hold no marker
    if they were cut, so the first occurrence of each is the one that was put in."""
    p, s, m = markers

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        halves = F.split(F.substr(output, F.lit(len(first) + 1)), rf"\Q{second}\E", 2)
        rest = F.split(halves[1], rf"\Q{m}\E", 2)
        return halves[0], rest[0], rest[1]

    prefix, suffix, middle = parts(p, s)
    suffix2, prefix2, middle2 = parts(s, p)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix2, middle2, suffix2)).otherwise(output)
