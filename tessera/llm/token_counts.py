"""Token counts of a sentencepiece BPE model without the ids of any document.

No piece of such a model crosses from another character to a space mark, nor holds a line feed. A text therefore falls
into pre-tokens (a run of spaces with the characters up to the next space or line feed) whose counts add up. The pieces of
each distinct pre-token of the corpus are counted once; the counts are then joined to the frequencies of the pre-tokens by
document and summed up. The most frequent pre-tokens join by a broadcast of bounded size, the others by a shuffle.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.shipping import ships

from .bpe import vocabulary
from .common import cut, slices, tidy
from .quality import BIN, BIN_LOW

#: Production parameters: pre-tokens whose counts are broadcast at most; bytes of a pre-token's name, beyond which its digest stands for it.
KNOWN, NAME = 1 << 18, 64
#: Distinct pre-tokens that a task counts before it hands them on; characters of a text that are split at a time.
FLUSH, CHUNK = 300_000, 1 << 20
SPACE_MARK = "▁"
RUNS = re.compile(r" +[^ ]*|[^ ]+")
SAFE = re.compile(r"(?<=[^ \n]) ")


def chunks(text: str) -> Iterator[str]:
    """The text in parts of about CHUNK characters, cut before a space that no space or line feed precedes, so that no pre-token is cut."""
    at = 0
    while len(text) - at > CHUNK and (found := SAFE.search(text, at + CHUNK)):
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def pre_tokens(text: str | None) -> Iterator[tuple[list[str], int]]:
    """The pre-tokens of each part of a text, and its number of line feeds, each of which is a token.

    A pre-token stands without its first space; one that starts a line after the first has a line feed before it instead. The
    model puts a space before the text."""
    if not text:
        return
    text = text.replace(SPACE_MARK, " ")
    for part in chunks(f" {text}"):
        found: list[str] = []
        lines = part.split("\n")
        for line in lines:
            if not line:
                continue
            words = line.split(" ")
            if "" in words[1:]:
                runs = RUNS.findall(line)
                found += [x[1:] for x in runs if x[0] == " "]
                if runs[0][0] != " ":
                    found.append("\n" + runs[0])
            else:
                if words[0]:
                    found.append("\n" + words[0])
                found += words[1:]
        yield found, len(lines) - 1


class Pieces:
    """Counts of pre-tokens by a model."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any("\n" in p or re.search(f"[^{SPACE_MARK}]{SPACE_MARK}", p) for p in pieces) or len(self.model.encode("\n")) != 2:
            raise ValueError("this model's pieces cross from a word to a space, or its line feed isn't one byte piece after a space mark")

    def count(self, keys: list[str]) -> list[int]:
        """One behind a space is counted as a text, before which the model puts one; one behind a line feed less that and the feed; an empty one is a space mark alone."""
        made = self.model.encode(keys, num_threads=1)
        return [len(x) - 2 * (k[:1] == "\n") if k else 1 for k, x in zip(keys, made)]


@lru_cache(maxsize=2)
def pieces_of(model: bytes) -> Pieces:
    return Pieces(model)


def name_of(key: str) -> str:
    """What a pre-token joins by: itself, or a digest if it is long (no pre-token starts with two line feeds)."""
    if len(key) <= NAME // 4 or len(raw := key.encode()) <= NAME:
        return key
    return "\n\n" + hashlib.sha256(raw).hexdigest()


class Held(dict):
    """Counts by name; a name that isn't held counts nothing and is noted."""

    def __init__(self, counts: dict[str, int]) -> None:
        super().__init__(counts)
        self.missed: list[str] = []

    def __missing__(self, key: str) -> int:
        self.missed.append(key)
        return 0


def distinct_pre_tokens(df: DataFrame, text_col: str = "text") -> DataFrame:
    """name, key (the pre-token), c (how often) of all texts of the column."""

    def run(batches):
        found: Counter = Counter()

        def rows():
            made = pa.RecordBatch.from_arrays([pa.array(map(name_of, found), pa.string()), pa.array(found, pa.string()), pa.array(found.values(), pa.int64())], names=["name", "key", "n"])
            found.clear()
            return made

        for batch in slices(batches, text_col):
            for text in batch[text_col].to_pylist():
                for keys, _ in pre_tokens(text):
                    found.update(keys)
                    if len(found) > FLUSH:
                        yield rows()
        if found:
            yield rows()
        tidy()

    return df.select(text_col).mapInArrow(run, "name string, key string, n long").groupBy("name").agg(F.any_value("key").alias("key"), F.sum("n").alias("c"))


def counted(distinct: DataFrame, path: str) -> DataFrame:
    """name, c, pieces of distinct_pre_tokens by the model at path: each is encoded once."""
    shared = distinct.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches):
        for batch in slices(batches, "key"):
            pieces = pieces_of(shared.value).count(batch["key"].to_pylist())
            yield pa.RecordBatch.from_arrays([batch["name"], batch["c"], pa.array(pieces, pa.int64())], names=["name", "c", "pieces"])

    return distinct.select("name", "key", "c").mapInArrow(run, "name string, c long, pieces long")


def most_frequent(counts: DataFrame, known: int) -> dict[str, int]:
    """Pieces by name of at most known names: those from the least frequency that at most known of them reach."""
    bins = sorted(counts.selectExpr("c AS v").selectExpr(f"{BIN} AS b").groupBy("b").agg(F.count("*").alias("n")).selectExpr(f"{BIN_LOW} AS low", "n").collect(), reverse=True)
    least, so_far = None, 0
    for low, n in bins:
        so_far += n
        if so_far > known:
            break
        least = low
    return {} if least is None else {r.name: r.pieces for r in counts.filter(F.col("c") >= least).select("name", "pieces").collect()}


@ships
def token_counts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", known: int = KNOWN) -> DataFrame:
    """id_col, n_bytes (UTF-8), n_tokens of every whole text, as the sentencepiece library counts them without begin and end.

    A null text counts as empty: 0 bytes, 0 tokens. Rows map one to one, repeated ids included; other columns of df are
    ignored; an empty table gives an empty one. At most known names of NAME bytes with their counts are broadcast. Of
    the others, each document hands on its frequencies, which join the counts by name; none of them is frequent, so
    that no task has a hot one. Documents take part in the join under names of their own, which match nothing.
    """
    counts = cut(counted(distinct_pre_tokens(df, text_col), path))
    shared = df.sparkSession.sparkContext.broadcast(most_frequent(counts, known))
    kind = df.schema[id_col].dataType

    def run(batches):
        held = Held(shared.value)
        for batch in slices(batches, text_col):
            size = pc.fill_null(pc.cast(pc.binary_length(batch[text_col]), pa.int64()), 0)
            rows, totals = batch["_row"].to_pylist(), []
            tail: list[tuple[int, str, int]] = []
            for row, text in zip(rows, batch[text_col].to_pylist()):
                total = 0
                for keys, lines in pre_tokens(text):
                    total += sum(map(held.__getitem__, keys)) + lines
                    if held.missed:
                        found = Counter(map(name_of, held.missed))
                        held.missed.clear()
                        for name in found.keys() & held.keys():
                            total += held[name] * found.pop(name)
                        tail += [(row, name, n) for name, n in found.items()]
                totals.append(total)
            own = pa.array([f"\n\n{row}" for row in rows], pa.string())
            yield pa.RecordBatch.from_arrays([batch["_row"], batch[id_col], own, size, pa.array(totals, pa.int64())], names=["_row", id_col, "name", "n_bytes", "n"])
            if tail:
                row, name, n = zip(*tail)
                yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.nulls(len(row), batch[id_col].type), pa.array(name, pa.string()), pa.nulls(len(row), pa.int64()), pa.array(n, pa.int64())], names=["_row", id_col, "name", "n_bytes", "n"])
        tidy()

    rows = df.select(id_col, text_col).withColumn("_row", F.monotonically_increasing_id())
    made = rows.mapInArrow(run, f"_row long, `{id_col}` {kind.simpleString()}, name string, n_bytes long, n long")
    joined = made.join(counts.select("name", "pieces"), "name", "left")
    tokens = F.col("n") * F.when(F.col("n_bytes").isNotNull(), F.lit(1)).otherwise(F.col("pieces"))
    return joined.groupBy("_row").agg(F.max(id_col).alias(id_col), F.max("n_bytes").alias("n_bytes"), F.sum(tokens).cast("long").alias("n_tokens")).select(id_col, "n_bytes", "n_tokens")
