"""Byte-level BPE by a tokenization automaton.

Starting from the automaton of all byte strings (one state, an arc to itself for each byte), every merge u v -> uv is
built in by one gadget, in the order of the merges: the target q of the arcs labelled u is copied into a state q' without
its arc v, the arcs labelled u are redirected to q', and each state with an arc u gets an arc uv to the old target of v.
The paths of the result are just the token sequences that BPE can produce, one for each byte string. All arcs
with a label lead to one state, so that target[label] and, for each state, the set of its labels are the whole table.
The sets are kept persistent (parent state, removed label, time of birth), 12 bytes a state: a label older than the state
is inherited from the parent, a younger one uv is there if u is.

A pre-token is encoded by two tables: bytes lead from node to node of the trie of all labels, which names the arcs that can
be read from a place, and (state, label) leads to the next state or nowhere. Each prefix has one path at most, so that a place
is left for good once no arc leads on from it, and the work is linear in the length of the pre-token. The label of a merge that
can't occur in any path isn't built in and is in neither table.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import map_text

#: Fixed value: the public pre-tokenizer pattern of this vocabulary. White space is the Unicode property White_Space.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"

#: Entries that a worker keeps of pre-tokens (of KEPT characters at most) and of table lookups before it starts anew.
CACHE, KEPT = 600_000, 64


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable Latin-1 bytes for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """The automaton of a vocabulary file of the tokenizers library (byte-level BPE)."""

    def __init__(self, content: bytes) -> None:
        spec = json.loads(content)
        letters = byte_letters()
        model = spec["model"]
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        as_bytes = {token: bytes(letters[c] for c in token) for token in model["vocab"] if token not in special}
        self.ids = {as_bytes[t]: i for t, i in model["vocab"].items() if t not in special}
        size = max([*model["vocab"].values(), *special.values()]) + 1
        self.labels: list[bytes] = [b""] * size
        for word, i in self.ids.items():
            self.labels[i] = word
        for word, i in special.items():
            self.labels[i] = word.encode()
        self.packed = [i.to_bytes(4, "little") for i in range(size)]
        self.special = special
        self.split_special = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(special, key=len, reverse=True)) + ")") if special else None
        self.pattern = regex.compile(PRE_TOKEN)
        self.target = [0] * size
        self.left = [-1] * size
        self.made = [0] * size
        self.parent, self.removed, self.born = [0], [-1], [0]
        missing: set[int] = set()
        for time, merge in enumerate(model["merges"], 1):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            u, v, uv = self.ids[as_bytes[a]], self.ids[as_bytes[b]], self.ids[as_bytes[a] + as_bytes[b]]
            if {u, v}.isdisjoint(missing) and self.allows(self.target[u], v):
                self._build_in(u, v, uv, time)
            else:
                missing.add(uv)
        for i in missing:
            del self.ids[self.labels[i]]
        self.next: dict[int, int] = {}
        self.label_at: dict[int, int] = {}
        for word, i in self.ids.items():
            node = 0
            for byte in word:
                node = self.next.setdefault(node << 8 | byte, len(self.next) + 1)
            self.label_at[node] = i
        self.known: dict[str, bytes] = {}
        self.looked: dict[int, bool] = {}

    def _build_in(self, u: int, v: int, uv: int, time: int) -> None:
        self.parent.append(self.target[u])
        self.removed.append(v)
        self.born.append(time)
        self.target[uv] = self.target[v]
        self.target[u] = len(self.parent) - 1
        self.left[uv], self.made[uv] = u, time

    def allows(self, state: int, label: int) -> bool:
        """Whether the state has an arc with the label."""
        while state:
            if self.made[label] >= self.born[state]:
                label = self.left[label]
            elif self.removed[state] == label:
                return False
            else:
                state = self.parent[state]
        return True

    def run(self, word: bytes) -> list[int]:
        """The path of one pre-token: the longest allowed arc first; a prefix that can't be carried on is never tried again. A label is the path of its own string, since no string has two."""
        if (whole := self.ids.get(word)) is not None:
            return [whole]
        target, looked, follow, label_at, size = self.target, self.looked, self.next.get, self.label_at, len(word)
        if len(looked) > CACHE:
            looked.clear()
        path: list[int] = []
        ends = [0]
        dead: set[int] = set()
        at = state = 0
        while at < size:
            arcs, node, end = [], 0, at
            while end < size and (node := follow(node << 8 | word[end])) is not None:
                end += 1
                if node in label_at:
                    arcs.append((end, label_at[node]))
            for end, label in reversed(arcs):
                if end in dead:
                    continue
                if at:
                    key = state << 20 | label
                    if (ok := looked.get(key)) is None:
                        ok = looked[key] = self.allows(state, label)
                    if not ok:
                        continue
                path.append(label)
                ends.append(end)
                break
            else:
                dead.add(at)
                path.pop()
                ends.pop()
            at = ends[-1]
            state = target[path[-1]] if path else 0
        return path

    def _piece(self, word: str) -> bytes:
        packed = self.packed
        made = b"".join([packed[i] for i in self.run(word.encode())])
        if len(word) <= KEPT:
            if len(self.known) >= CACHE:
                self.known.clear()
            self.known[word] = made
        return made

    def encode(self, text: str, special: bool = True) -> bytes:
        """Ids as little-endian unsigned 32-bit integers. special: strings of special tokens become their ids, as is the library's default."""
        if special and self.split_special is not None and any(x in text for x in self.special):
            return b"".join(self.packed[self.special[x]] if x in self.special else self.encode(x, False) for x in self.split_special.split(text))
        words = self.pattern.findall(text)
        known, piece = self.known.get, self._piece
        return b"".join([known(w) or piece(w) for w in words])

    def decode(self, ids: bytes) -> str:
        """The labels of the arcs in a row, as text; what isn't UTF-8 becomes U+FFFD."""
        labels = self.labels
        return b"".join([labels[i] for i in np.frombuffer(ids, dtype="<u4").tolist()]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def automaton(content: bytes) -> Automaton:
    """One automaton for each vocabulary and worker."""
    return Automaton(content)


def vocabulary(path: str) -> bytes:
    """The content of a vocabulary file, which the driver reads (about 1.5 MB; the tasks get it with their code)."""
    with open(path, "rb") as f:
        return f.read()


def encode_decode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = True) -> DataFrame:
    """Encodes every whole text and decodes the ids again.

    Returns id_col, ids (binary, little-endian unsigned 32-bit), decoded (string; null unless decode). A null text counts
    as empty and gives no ids. Rows map one to one, so repeated ids stay repeated; other columns of df are ignored.
    """
    shared = df.sparkSession.sparkContext.broadcast(vocabulary(path))

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        a = automaton(shared.value)
        ids = [a.encode(t) if t else b"" for t in batch[text_col].to_pylist()]
        text = pa.array([a.decode(x) for x in ids] if decode else [None] * len(ids), pa.string())
        return pa.RecordBatch.from_arrays([batch[id_col], pa.array(ids, pa.binary()), text], names=[id_col, "ids", "decoded"])

    return map_text(df, [id_col], text_col, f, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, ids binary, decoded string")
