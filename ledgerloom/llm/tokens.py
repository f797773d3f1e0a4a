"""Token counts that follow edits.

A document keeps a tree over its pre-tokens: leaves hold the characters and tokens of
some dozens of pre-tokens, inner nodes hold sums.  An edit goes down the tree to the
leaves it touches, splits and encodes anew only these and what the edit's neighbours
can change, and updates the sums above them.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import text_of, vocabulary_path

#: Fixed value: how the vocabulary splits text into pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens of a new leaf, most of a leaf before its tree is laid out anew, children.
LEAF, FULL, FANOUT = 64, 1024, 16
#: Characters behind a pre-token that its end depends on: where it ends, the matcher
#: has looked at most this far ahead.
AHEAD = 2
_SEEN = 200_000


class Counter:
    """Counts tokens of pre-tokens; remembers a bounded number of them."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = tiktoken.Encoding(
            "counts", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={}
        )
        self.split = regex.compile(PATTERN)
        self.seen: dict[str, int] = {}

    def count(self, piece: str) -> int:
        found = self.seen.get(piece)
        if found is None:
            if len(self.seen) >= _SEEN:
                self.seen.clear()
            raw = piece.encode("utf-8", "replace")
            found = 1 if raw in self.ranks else len(self.tokens.encode_ordinary(piece))
            self.seen[piece] = found
        return found


_LOADED: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """The counter of a vocabulary file, once a process."""
    if path not in _LOADED:
        _LOADED[path] = Counter(path)
    return _LOADED[path]


@dataclass
class Tree:
    """Sums of characters and tokens; the first level is the leaves, the last one node."""

    chars: list[list[int]]
    tokens: list[list[int]]

    @classmethod
    def over(cls, leaves: list[tuple[int, int]]) -> Tree:
        chars, tokens = [[c for c, _ in leaves] or [0]], [[t for _, t in leaves] or [0]]
        while len(chars[-1]) > 1:
            for levels in (chars, tokens):
                low = levels[-1]
                levels.append([sum(low[i : i + FANOUT]) for i in range(0, len(low), FANOUT)])
        return cls(chars, tokens)

    @classmethod
    def read(cls, leaves: int, chars: list[int], tokens: list[int]) -> Tree:
        sizes = [leaves]
        while sizes[-1] > 1:
            sizes.append(-(-sizes[-1] // FANOUT))
        cut = lambda flat: [flat[sum(sizes[:i]) :][:n] for i, n in enumerate(sizes)]
        return cls(cut(chars), cut(tokens))

    def flat(self) -> dict:
        return {
            "leaves": len(self.chars[0]),
            "chars": [n for level in self.chars for n in level],
            "tokens": [n for level in self.tokens for n in level],
        }

    @property
    def total(self) -> int:
        return self.tokens[-1][0]

    def leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds a place (the last one for the end), and its start."""
        start = node = 0
        for level in range(len(self.chars) - 1, -1, -1):
            row = self.chars[level]
            if level < len(self.chars) - 1:
                node *= FANOUT
            last = min(node + FANOUT, len(row)) - 1 if level < len(self.chars) - 1 else 0
            while node < last and start + row[node] <= place:
                start += row[node]
                node += 1
        return node, start

    def put(self, leaf: int, chars: int, tokens: int) -> int:
        """Set a leaf and add the difference to the sums above it; nodes that changed."""
        more = chars - self.chars[0][leaf], tokens - self.tokens[0][leaf]
        if more == (0, 0):
            return 0
        for level in range(len(self.chars)):
            self.chars[level][leaf] += more[0]
            self.tokens[level][leaf] += more[1]
            leaf //= FANOUT
        return len(self.chars)


def build(text: str, count: Counter) -> Tree:
    """The tree of a whole text."""
    leaves, chars, tokens, held = [], 0, 0, 0
    known, slow = count.seen, count.count
    for piece in count.split.findall(text):
        n = known.get(piece)
        tokens += slow(piece) if n is None else n
        chars += len(piece)
        held += 1
        if held == LEAF:
            leaves.append((chars, tokens))
            chars = tokens = held = 0
    if held:
        leaves.append((chars, tokens))
    return Tree.over(leaves)


def edit(
    text: str, tree: Tree, start: int, length: int, insert: str, count: Counter
) -> tuple[str, Tree, int, int]:
    """Apply one edit; the new text and tree, characters encoded and nodes changed.

    The start and length are cut to the text.  Splitting starts at the last leaf whose
    end the edit can't move, and stops where a new pre-token ends at an old leaf's end
    behind the edit: from there on the old leaves hold.
    """
    start = max(0, min(start, len(text)))
    stop = max(start, min(len(text), start + length))
    new = text[:start] + insert + text[stop:]
    shift = len(insert) - (stop - start)
    leaf, begin = tree.leaf_at(max(0, start - AHEAD - 1))
    # The leaf's start is a boundary whose pre-token ends before anything that changed.
    last, end = tree.leaf_at(stop)
    end += tree.chars[0][last]
    place, pieces, leaves = begin, [], len(tree.chars[0])
    settled = False
    while place < len(new):
        piece = count.split.match(new, place).group()
        pieces.append((len(piece), count.count(piece)))
        place += len(piece)
        while last < leaves - 1 and place - shift > end:
            last += 1
            end += tree.chars[0][last]
        if place - shift == end and end >= stop:
            settled = True
            break
    if not settled:
        last = leaves - 1
    encoded = sum(c for c, _ in pieces)
    slots = last - leaf + 1
    if len(pieces) > FULL * slots:
        return new, build(new, count), len(new), 0
    share = -(-len(pieces) // slots) if pieces else 1
    changed = 0
    for i in range(slots):
        own = pieces[i * share : (i + 1) * share]
        changed += tree.put(leaf + i, sum(c for c, _ in own), sum(t for _, t in own))
    return new, tree, encoded, changed


_TREE = pa.struct(
    [("leaves", pa.int32()), ("chars", pa.list_(pa.int32())), ("tokens", pa.list_(pa.int32()))]
)
_TREE_SQL = "struct<leaves:int,chars:array<int>,tokens:array<int>>"


def trees(text: str | Column = "text", vocabulary: str | None = None) -> Column:
    """Column with the tree of each whole text; null is an empty text.

    The state to keep with a document: two numbers for every 64 pre-tokens, and sums.
    """
    path = vocabulary or vocabulary_path("byte_bpe_50k.tiktoken")

    @F.arrow_udf(_TREE_SQL)
    def built(texts: pa.Array) -> pa.Array:
        own = counter(path)
        return pa.array([build(t.as_py(), own).flat() for t in texts], _TREE)

    return built(text_of(text))


def edited(text: Column, tree: Column, edits: Column, vocabulary: str | None = None) -> Column:
    """Column with texts and trees after edits, and what the edits cost.

    `edits` is an array of `struct<start, length, insert>`, applied in order, each to
    the text that the one before left.  Null edits, and null fields of one, change
    nothing.  The result is `struct<text, tree, tokens, encoded, nodes>`.
    """
    path = vocabulary or vocabulary_path("byte_bpe_50k.tiktoken")
    kind = pa.struct(
        [("text", pa.string()), ("tree", _TREE), ("tokens", pa.int64()), ("encoded", pa.int64()), ("nodes", pa.int64())]
    )

    @F.arrow_udf(f"struct<text:string,tree:{_TREE_SQL},tokens:long,encoded:long,nodes:long>")
    def apply(texts: pa.Array, states: pa.Array, changes: pa.Array) -> pa.Array:
        own, out = counter(path), []
        for new, state, steps in zip(texts, states, changes):
            new, state = new.as_py(), Tree.read(**state.as_py())
            encoded = nodes = 0
            for step in steps.as_py() or []:
                if step is None:
                    continue
                new, state, chars, changed = edit(
                    new, state, step["start"] or 0, step["length"] or 0, step["insert"] or "", own
                )
                encoded += chars
                nodes += changed
            out.append(
                {"text": new, "tree": state.flat(), "tokens": state.total, "encoded": encoded, "nodes": nodes}
            )
        return pa.array(out, kind)

    return apply(text_of(text), tree, edits)


def derived_edits(text: str, *seeds: str) -> Column:
    """Two edits that follow from a row itself: a replaced passage and an added one.

    Places and lengths are hashes of the seed columns; the words put in are cut from
    the text.
    """
    draw = lambda salt, most: F.pmod(F.xxhash64(F.lit(salt), *seeds), most).cast("int")
    size = F.length(text)

    def one(salt: str, most_cut: int) -> Column:
        words = F.substr(F.col(text), draw(salt + "from", size + 1) + 1, draw(salt + "words", F.lit(40)))
        return F.struct(
            draw(salt + "start", size + 1).alias("start"),
            draw(salt + "cut", F.lit(most_cut)).alias("length"),
            words.alias("insert"),
        )

    return F.array(one("a", 30), one("b", 1))


def counted(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", edits: Column | None = None, vocabulary: str | None = None
) -> DataFrame:
    """Tokens of each document before and after its edits, one row per row of `docs`.

    Columns `doc_id, n_chars, n_tokens, n_edits, n_tokens_after, n_chars_after,
    chars_encoded, nodes_changed`.  Trees and edits stay in the document's row, so
    nothing is shuffled.  Null and empty texts have no tokens; `edits` are by default
    those of `derived_edits`.  Extra columns are not read.
    """
    rows = docs.select(
        F.col(id_column).alias("doc_id"),
        text_of(text).alias("text"),
        *([edits.alias("edits")] if edits is not None else []),
    )
    if edits is None:
        rows = rows.withColumn("edits", derived_edits("text", "doc_id", "text"))
    rows = rows.withColumn("tree", trees("text", vocabulary))
    after = rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.element_at("tree.tokens", -1).cast("long").alias("n_tokens"),
        F.coalesce(F.size("edits"), F.lit(0)).cast("long").alias("n_edits"),
        edited(F.col("text"), F.col("tree"), F.col("edits"), vocabulary).alias("x"),
    )
    return after.select(
        "doc_id",
        "n_chars",
        "n_tokens",
        "n_edits",
        F.col("x.tokens").alias("n_tokens_after"),
        F.length("x.text").cast("long").alias("n_chars_after"),
        F.col("x.encoded").alias("chars_encoded"),
        F.col("x.nodes").alias("nodes_changed"),
    )
