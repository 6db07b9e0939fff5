"""Fill-in-middle transformation (operator 13): texts cut at line ends and reordered.

Lines are found by a parallel automaton scan.  A byte automaton knows whether a line
is open and how much of a marker (``<P>``, ``<S>``, ``<M>``) it has just read: eight
states.  A chunk of a text is read without knowing the state it begins in: it gives its
transition function, a state for each start state, and the lines that begin in it, a
count for each start state.  Functions are composed pairwise (composition is
associative), which gives every chunk its entry state and the lines before it; each
chunk then selects the cuts that fall into it by itself.

A text of one chunk is composed and cut where it is read, and isn't shuffled.  A longer
one is dealt out by chunk: functions, entry states, cuts and outputs are rows of chunks,
so no task holds more of a giant text than a chunk at a time, except the one that reads
its row.  Output comes in pieces, one for a text of one chunk; the pieces of a row in
order are its output.

Defined results: a null text counts as empty, an empty text is plain with no lines; a
text that holds a marker is plain; texts of any length are read whole; a null id enters
the hash as nothing after the seed; rows with equal ids are cut alike where their texts
are equal; repeated rows and null ids are kept, each by itself; empty tables give empty
tables; columns other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, small_batches, text_of, working_on

#: Code points of a chunk.
CHUNK = 1 << 16
PREFIX, MIDDLE, SUFFIX = "<P>", "<M>", "<S>"
#: Order of parts in an output, as places of (prefix, middle, suffix).
ORDER = {"plain": (0, 1, 2), "psm": (0, 2, 1), "spm": (1, 2, 0)}

NEWLINE, OPENING, LETTER, CLOSING = 1, 2, 3, 4
STATES, START, FOUND = 8, 0, 3


def _automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of each byte; next state and lines begun by class and state.  A state is
    twice the marker's progress (0 to 2, 3: found) plus 1 if a line is open."""
    classes = np.zeros(256, np.uint8)
    classes[list(b"\n<PSM>")] = [NEWLINE, OPENING, LETTER, LETTER, LETTER, CLOSING]
    after, begun = np.zeros((5, STATES), np.uint8), np.zeros((5, STATES), np.int64)
    for kind in range(5):
        for state in range(STATES):
            progress, is_open = divmod(state, 2)
            if progress != FOUND:
                progress = 1 if kind == OPENING else progress + 1 if (progress, kind) in ((1, LETTER), (2, CLOSING)) else 0
            after[kind, state] = 2 * progress + (kind != NEWLINE)
            begun[kind, state] = not is_open
    return classes, after, begun


CLASSES, AFTER, BEGUN = _automaton()


def then(f: np.ndarray, n: np.ndarray, g: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First (f, n), then (g, m), for rows of functions and counts."""
    at = f.astype(np.intp)
    return np.take_along_axis(g, at, 1), n + np.take_along_axis(m, at, 1)


def scan(chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Each chunk's transition function and counts of lines begun, by start state."""
    f_out, n_out = np.tile(np.arange(STATES, dtype=np.uint8), (len(chunks), 1)), np.zeros((len(chunks), STATES), np.int64)
    data = np.frombuffer(b"".join(chunks), np.uint8)
    if not len(data):
        return f_out, n_out
    ends = np.cumsum([len(c) for c in chunks])
    kind = CLASSES[data]
    told = kind != 0
    # All bytes of a run without meaning act like its first.
    keep = told.copy()
    keep[1:] |= told[:-1]
    keep[0] = True
    keep[ends[ends < len(data)]] = True
    at = np.flatnonzero(keep)
    seg = np.searchsorted(ends, at, side="right")
    f, n = AFTER[kind[at]], BEGUN[kind[at]]
    while True:
        first = np.concatenate([[True], seg[1:] != seg[:-1]])
        if first.all():
            break
        place = np.arange(len(seg))
        even = np.flatnonzero((place - place[first][np.cumsum(first) - 1]) % 2 == 0)
        pair = np.flatnonzero(np.append(~first, False)[even + 1])
        g, m, right = f[even], n[even], even[pair] + 1
        g[pair], m[pair] = then(g[pair], m[pair], f[right], n[right])
        f, n, seg = g, m, seg[even]
    f_out[seg], n_out[seg] = f, n
    return f_out, n_out


def entries(f: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """State after, and lines begun up to, each chunk of one text, by composing in doubling steps."""
    step = 1
    while step < len(f):
        g, m = then(f[:-step], n[:-step], f[step:], n[step:])
        f, n = np.concatenate([f[:step], g]), np.concatenate([n[:step], m])
        step *= 2
    return f[:, START], n[:, START]


def line_end(newlines: np.ndarray, size: int, is_open: bool, before: int, units: int) -> int:
    """Bytes of a chunk that belong to the text's first ``units`` lines."""
    i = units - before - (not is_open)
    return 0 if units == 0 or i < 0 else size if i >= len(newlines) else int(newlines[i]) + 1


def chars(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def form_of(is_plain: bool, h3: int, h4: int, fim_pct: int, spm_pct: int) -> str:
    return "plain" if is_plain or h3 % 100 >= fim_pct else "spm" if h4 % 100 < spm_pct else "psm"


def arranged(form: str, prefix: str, middle: str, suffix: str) -> str:
    if form == "plain":
        return prefix + middle + suffix
    return PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle if form == "psm" else SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle


def restored(output: Column, form: Column) -> Column:
    """The text of a whole output."""
    part = F.split(output, "<[PSM]>")
    at = lambda *places: F.concat(*[F.get(part, F.lit(i)) for i in places])
    return F.when(form == "plain", output).when(form == "psm", at(1, 3, 2)).otherwise(at(2, 3, 1))


RESULT = "n long, form string, prefix_chars long, middle_chars long, piece long, output string"


def _whole_texts(fim_pct: int, spm_pct: int):
    """Cuts texts of one chunk."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        working_on("fill in middle")
        for b in batches:
            raw = [t.encode("utf-8", "surrogatepass") for t in b["text"]]
            f, n = scan(raw)
            rows = []
            for text, data, state, units, h1, h2, h3, h4 in zip(b["text"], raw, f[:, START].tolist(), n[:, START].tolist(), *(b[h].tolist() for h in ("h1", "h2", "h3", "h4"))):
                form = form_of(not data or state // 2 == FOUND, h3, h4, fim_pct, spm_pct)
                if form == "plain":
                    rows.append((units, form, None, None, text))
                    continue
                bytes_ = np.frombuffer(data, np.uint8)
                newlines = np.flatnonzero(bytes_ == 10)
                x, y = sorted(line_end(newlines, len(data), False, 0, h % (units + 1)) for h in (h1, h2))
                a, m = chars(bytes_[:x]), chars(bytes_[x:y])
                rows.append((units, form, a, m, arranged(form, text[:a], text[a : a + m], text[a + m :])))
            out = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
            out[["prefix_chars", "middle_chars"]] = out[["prefix_chars", "middle_chars"]].astype("Int64")
            yield out.assign(id=b["id"].to_numpy(), row=None, piece=0)

    return run


def _chunks(size: int):
    """Deals long texts out; a row's key is made up here and settled with its chunks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                key = uuid.uuid4().hex
                for no, at in enumerate(range(0, len(r.text), size)):
                    yield pd.DataFrame([(r.id, key, r.h1, r.h2, r.h3, r.h4, no, r.text[at : at + size])], columns=["id", "row", "h1", "h2", "h3", "h4", "no", "chunk"])

    return run


def _functions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        f, n = scan([c.encode("utf-8", "surrogatepass") for c in b["chunk"]])
        yield b[["row", "h1", "h2", "h3", "h4", "no"]].assign(after=f.astype(np.int64).tolist(), begun=n.tolist())


def _compose(fim_pct: int, spm_pct: int):
    """One text's chunk functions, at most a few ten thousand rows as a text is one row of
    the input, to entry states, lines before each chunk and the text's cuts."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("no")
        state, units = entries(np.array(pdf["after"].tolist(), np.uint8), np.array(pdf["begun"].tolist(), np.int64))
        h1, h2, h3, h4 = (int(pdf[h].iloc[0]) for h in ("h1", "h2", "h3", "h4"))
        n = int(units[-1])
        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        form = form_of(state[-1] // 2 == FOUND, h3, h4, fim_pct, spm_pct)
        entry, before = np.concatenate([[START], state[:-1]]), np.concatenate([[0], units[:-1]])
        return pd.DataFrame({"row_": pdf["row"], "no_": pdf["no"], "is_open": entry % 2 == 1, "before": before, "n": n, "a": a, "b": b, "form": form})

    return run


def _cut_chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each chunk's share of prefix, middle and suffix as pieces of the output; the first chunk adds the markers."""
    for b in batches:
        rows = []
        for r in b.itertuples(index=False):
            data = r.chunk.encode("utf-8", "surrogatepass")
            bytes_ = np.frombuffer(data, np.uint8)
            if r.form == "plain":
                rows.append((r.id, r.row, r.n, r.form, None, None, r.no, r.chunk))
                continue
            newlines = np.flatnonzero(bytes_ == 10)
            x, y = (line_end(newlines, len(data), r.is_open, r.before, units) for units in (r.a, r.b))
            p, m = chars(bytes_[:x]), chars(bytes_[x:y])
            place = ORDER[r.form]
            for part, mark, text in zip(place, (PREFIX, MIDDLE, SUFFIX), (r.chunk[:p], r.chunk[p : p + m], r.chunk[p + m :])):
                if r.no == 0:
                    rows.append((r.id, r.row, r.n, r.form, 0, 0, part << 40, mark))
                if text:
                    rows.append((r.id, r.row, r.n, r.form, p if part == place[0] else 0, m if part == place[1] else 0, (part << 40) + 1 + r.no, text))
        out = pd.DataFrame(rows, columns=["id", "row", "n", "form", "p", "m", "piece", "output"])
        out[["p", "m"]] = out[["p", "m"]].astype("Int64")
        yield out


def fill_in_middle(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, fim_pct: int = 100, spm_pct: int = 50, chunk: int = CHUNK) -> DataFrame:
    """Rows of output pieces: the id, row (null where the output is one piece, else a key
    that the pieces of one input row share), n lines, form, prefix_chars, middle_chars
    (null if plain), piece (ascending within a row) and output, the piece's text."""
    whole, long = outputs(df, id_col, text_col, seed, fim_pct, spm_pct, chunk)
    return whole.union(long)


def outputs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, fim_pct: int = 100, spm_pct: int = 50, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """The rows of ``fill_in_middle`` as two tables: outputs of one piece, and of several."""
    small_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()  # ids travel as text: pandas would round long ones next to nulls
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    source = df.select(F.col(id_col).cast("string").alias("id"), text_of(text_col).alias("text"), *[F.conv(F.substring(hashed, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)])
    whole = source.filter(F.length("text") <= chunk).mapInPandas(_whole_texts(fim_pct, spm_pct), f"id string, row string, {RESULT}")

    # Built from tables that stay as they are: keys are made up once.
    long = settle(source.filter(F.length("text") > chunk).mapInPandas(_chunks(chunk), "id string, row string, h1 long, h2 long, h3 long, h4 long, no long, chunk string"), "fim-chunks")
    functions = long.drop("id").mapInPandas(_functions, "row string, h1 long, h2 long, h3 long, h4 long, no long, after array<long>, begun array<long>")
    entered = functions.groupBy("row").applyInPandas(_compose(fim_pct, spm_pct), "row_ string, no_ long, is_open boolean, before long, n long, a long, b long, form string")
    joined = long.join(entered, (F.col("row") == F.col("row_")) & (F.col("no") == F.col("no_"))).select("id", "row", "no", "chunk", "is_open", "before", "n", "a", "b", "form")
    cut = settle(joined.mapInPandas(_cut_chunks, "id string, row string, n long, form string, p long, m long, piece long, output string"), "fim-pieces")
    sizes = cut.groupBy("row").agg(F.sum("p").alias("prefix_chars"), F.sum("m").alias("middle_chars")).withColumnRenamed("row", "row_")
    parted = cut.join(sizes, F.col("row") == F.col("row_")).select("id", "row", "n", "form", "prefix_chars", "middle_chars", "piece", "output")
    named = [F.col("id").cast(kind).alias(id_col), *parted.columns[1:]]
    return whole.select(named), parted.select(named)


def _hash_of_pieces(column: str):
    """SHA-256 of each row's pieces in the order they come in, a piece at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        row = state = None
        for b in batches:
            done = []
            for key, text in zip(b["row"], b["output"]):
                if key != row:
                    if row is not None:
                        done.append((row, state.hexdigest()))
                    row, state = key, hashlib.sha256()
                state.update(text.encode("utf-8", "surrogatepass"))
            yield pd.DataFrame(done, columns=["row", column])
        if row is not None:
            yield pd.DataFrame([(row, state.hexdigest())], columns=["row", column])

    return run


def restored_pieces(pieces: DataFrame) -> DataFrame:
    """(row, part, piece, output) of outputs in several pieces: the pieces of the text, in
    order of part (0 prefix, 1 middle, 2 suffix) and piece, found from output and form alone."""
    marks = F.when((F.col("form") != "plain") & F.col("output").isin(PREFIX, MIDDLE, SUFFIX), F.col("output"))
    seen = pieces.select("row", "form", "piece", "output", marks.alias("mark"))
    part = F.last("mark", ignorenulls=True).over(Window.partitionBy("row").orderBy("piece"))
    rank = F.when(part == MIDDLE, 1).when(part == SUFFIX, 2).otherwise(0)
    return seen.withColumn("part", rank).filter("mark is null").select("row", "part", "piece", "output")


def digests(whole: DataFrame, long: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row for each input row of ``outputs``: id, n, form, prefix_chars, middle_chars, and SHA-256 of
    its output and of the text rebuilt from output and form."""
    facts = [id_col, "n", "form", "prefix_chars", "middle_chars"]
    one = whole.select(*facts, F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
    streamed = lambda rows, order, name: rows.repartition("row").sortWithinPartitions("row", *order).select("row", "output").mapInPandas(_hash_of_pieces(name), f"row string, {name} string")
    out = streamed(long, ["piece"], "output_sha256").withColumnRenamed("row", "o")
    back = streamed(restored_pieces(long), ["part", "piece"], "restored_sha256").withColumnRenamed("row", "r")
    rows = long.select("row", *facts).distinct()
    many = rows.join(out, F.col("row") == F.col("o")).join(back, F.col("row") == F.col("r")).select(*facts, "output_sha256", "restored_sha256")
    return one.union(many)
