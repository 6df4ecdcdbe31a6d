"""Edit-aware token counts: a segment tree of pre-token segments per document.

A leaf is a stretch of text of about LEAF characters that begins at a safe boundary (white space after another
character, which no pre-token crosses), with its token count; inner nodes hold sums of length and tokens, level by
level. The edits of a document are applied together. The leaves that they touch are found from the top by the stored
sums of lengths; touched leaves that lie next to each other are one region, which takes in a neighbour where its end is
no safe boundary of the new text. Each region is cut into leaves and encoded once, and only the sums above it are renewed;
where the number of leaves changed, those behind it too. All other leaves keep their counts, and the result equals a
count of the whole new text.

A tree is kept as arrays: the leaves' lengths and tokens, and for each level above the sums of runs of FAN nodes.

Edits are places in the text that the tree was built for, in any order; they apply in the order of their starts (ties in
the given order), and one that reaches into another begins where that one ends. Work is linear in the text and the edits.
Cases: a null text is empty, one empty leaf; null edits count as none, and so does an edit without a start; a null length
is zero and a null new text is empty; edits past the end are clipped to it; a text without a safe boundary, however long,
is one leaf; repeated rows each have their own tree; other columns are ignored; an empty table gives an empty one.
"""

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .byte_bpe import SAFE, encode

LEAF, FAN = 64, 16
LEVELS = "array<array<bigint>>"
TREE = f"lengths array<int>, tokens array<int>, length_sums {LEVELS}, token_sums {LEVELS}"
COLUMNS = ["lengths", "tokens", "length_sums", "token_sums"]
EDITS = "array<struct<start:int,length:int,new:string>>"


def leaf_texts(text: str) -> list[str]:
    found, begin = [], 0
    while len(text) - begin > LEAF:
        cut = SAFE.search(text, begin + LEAF)
        if not cut:
            break
        found.append(text[begin : cut.start()])
        begin = cut.start()
    return [*found, text[begin:]]


class Tree:
    """lengths[0] and tokens[0] are those of each leaf; level k + 1 holds the sums of runs of FAN nodes of level k."""

    def __init__(self, lengths: list[list[int]], tokens: list[list[int]]):
        self.lengths, self.tokens = lengths, tokens

    @property
    def n_tokens(self) -> int:
        return self.tokens[-1][0]

    def renew(self, spans: list[tuple[int, int]]) -> None:
        """The sums above the leaves of spans (first, end); each node once."""
        for levels in (self.lengths, self.tokens):
            level, now = 0, spans
            while len(levels[level]) > 1:
                below, size = levels[level], -(-len(levels[level]) // FAN)
                if level + 1 == len(levels):
                    levels.append([])
                above = levels[level + 1]
                if len(above) < size:
                    above += [0] * (size - len(above))
                del above[size:]
                up, done = [], 0
                for first, end in now:
                    begin, stop = max(done, first // FAN), min(size, -(-end // FAN))
                    for k in range(begin, stop):
                        above[k] = sum(below[k * FAN : k * FAN + FAN])
                    if begin < stop:
                        up.append((begin, stop))
                        done = stop
                now, level = up, level + 1
            del levels[level + 1 :]

    def leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds the character at place (the last one at the end), and where it begins."""
        node, begin = 0, 0
        for level in range(len(self.lengths) - 1, -1, -1):
            nodes = self.lengths[level]
            node = node * FAN if level < len(self.lengths) - 1 else 0
            last = min(node + FAN, len(nodes)) - 1 if level < len(self.lengths) - 1 else 0
            while node < last and place >= begin + nodes[node]:
                begin += nodes[node]
                node += 1
        return node, begin


def build(text: str, count) -> Tree:
    leaves = leaf_texts(text)
    tree = Tree([[len(t) for t in leaves]], [[count(t) for t in leaves]])
    tree.renew([(0, len(leaves))])
    return tree


def clipped(edits, size: int) -> list[tuple[int, int, str]]:
    """Start, end and new text of each edit, in order and apart from each other."""
    found, at = [], 0
    for start, length, new in sorted((e for e in edits if e[0] is not None), key=lambda e: min(max(e[0], 0), size)):
        start = max(at, min(max(start, 0), size))
        at = max(start, min(start + max(length or 0, 0), size))
        found.append((start, at, new or ""))
    return found


@dataclass
class Region:
    """Leaves first to last, text from begin to end, and the edits in it."""

    first: int
    last: int
    begin: int
    end: int
    edits: list

    def take(self, other: "Region") -> None:
        self.last, self.end = max(self.last, other.last), max(self.end, other.end)
        self.edits += other.edits

    def new_text(self, text: str) -> str:
        parts, at = [], self.begin
        for start, stop, new in self.edits:
            parts += (text[at:start], new)
            at = stop
        return "".join((*parts, text[at : self.end]))


def regions(text: str, tree: Tree, edits: list[tuple[int, int, str]]) -> list[Region]:
    """The stretches of leaves to encode again, with safe boundaries at both ends in the new text.

    One leaf more on a side is always enough: one that no edit touches begins and ends at a safe boundary.
    """
    leaves, touched, found = tree.lengths[0], [], []
    for edit in edits:
        (first, begin), (last, at) = tree.leaf_at(edit[0]), tree.leaf_at(max(edit[0], edit[1] - 1))
        now = Region(first, last, begin, at + leaves[last], [edit])
        if touched and first <= touched[-1].last + 1:
            touched[-1].take(now)
        else:
            touched.append(now)
    for now in touched:
        new = now.new_text(text)
        head = new[:1] or text[now.end : now.end + 1]
        if now.first and head and head not in " \n":
            now.first -= 1
            now.begin -= leaves[now.first]
        if now.last < len(leaves) - 1 and new[-1:].isspace():
            now.last += 1
            now.end += leaves[now.last]
        if found and now.first <= found[-1].last:
            found[-1].take(now)
        else:
            found.append(now)
    return found


def edit(text: str, tree: Tree, edits, count) -> tuple[str, int]:
    """The new text, and how many characters were encoded again; tree is brought up to date."""
    parts, at, leaf, again = [], 0, 0, 0
    lengths, tokens, spans, moved_from = [], [], [], None
    for now in regions(text, tree, clipped(edits, len(text))):
        new = now.new_text(text)
        leaves = leaf_texts(new) if new else []
        lengths += tree.lengths[0][leaf : now.first]
        tokens += tree.tokens[0][leaf : now.first]
        if moved_from is None and len(leaves) != now.last - now.first + 1:
            moved_from = len(lengths)
        spans.append((len(lengths), len(lengths) + len(leaves)))
        lengths += map(len, leaves)
        tokens += map(count, leaves)
        parts += (text[at : now.begin], new)
        at, leaf, again = now.end, now.last + 1, again + len(new)
    if not spans:
        return text, 0
    lengths += tree.lengths[0][leaf:]
    tokens += tree.tokens[0][leaf:]
    if not lengths:
        lengths, tokens = [0], [0]
    tree.lengths[0], tree.tokens[0] = lengths, tokens
    if moved_from is not None:
        spans = [x for x in spans if x[0] < moved_from] + [(max(0, moved_from - 1), len(lengths))]
    tree.renew(spans)
    return "".join((*parts, text[at:])), again


def stored(built: list[Tree]) -> list[pa.Array]:
    """The columns of TREE."""
    leaves = [pa.array([x[0] for x in levels], pa.list_(pa.int32())) for levels in ([t.lengths for t in built], [t.tokens for t in built])]
    return leaves + [pa.array([x[1:] for x in levels], pa.list_(pa.list_(pa.int64()))) for levels in ([t.lengths for t in built], [t.tokens for t in built])]


def trees(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, text, and the tree (the columns of TREE) of every document."""
    kept = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches):
        for batch in batches:
            built = [build(t, lambda x: len(encode(x, ranks_path, pattern))) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text"), *stored(built)], ["id", "text", *COLUMNS])

    return kept.mapInArrow(run, f"id {kept.schema['id'].dataType.simpleString()}, text string, {TREE}").withColumnRenamed("id", id_col)


def edited(with_trees: DataFrame, ranks_path: str, pattern: str, edits_of=None, id_col: str = "doc_id") -> DataFrame:
    """Apply edits to trees with their texts.

    The edits are those of the column edits (EDITS), or what edits_of(text) gives: start, length and new of each. Returns
    id_col, the new text and tree, n_before, n_after and reencoded (characters encoded again).
    """
    own = [] if edits_of else ["edits"]
    kept = with_trees.select(F.col(id_col).alias("id"), "text", *COLUMNS, *own)

    def run(batches):
        count = lambda x: len(encode(x, ranks_path, pattern))
        for batch in batches:
            texts, built, before, work = [], [], [], []
            for row in batch.to_pylist():
                tree = Tree([row["lengths"], *row["length_sums"]], [row["tokens"], *row["token_sums"]])
                before.append(tree.n_tokens)
                edits = edits_of(row["text"]) if edits_of else [(e["start"], e["length"], e["new"]) for e in row["edits"] or () if e]
                text, again = edit(row["text"], tree, edits, count)
                texts.append(text)
                built.append(tree)
                work.append(again)
            columns = [batch.column("id"), pa.array(texts, pa.string()), *stored(built), pa.array(before, pa.int64()), pa.array([t.n_tokens for t in built], pa.int64()), pa.array(work, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "text", *COLUMNS, "n_before", "n_after", "reencoded"])

    id_type = kept.schema["id"].dataType.simpleString()
    return kept.mapInArrow(run, f"id {id_type}, text string, {TREE}, n_before bigint, n_after bigint, reencoded bigint").withColumnRenamed("id", id_col)


def masking(pattern: str, mask: str):
    """For edited(): the edits that replace each match of pattern (of Python's re) by mask."""
    seek = re.compile(pattern)
    return lambda text: [(m.start(), m.end() - m.start(), mask) for m in seek.finditer(text)]


def appended(text: Column, new: str) -> Column:
    """A column of edits that add new at the end."""
    return F.array(F.struct(F.length(text).alias("start"), F.lit(0).alias("length"), F.lit(new).alias("new")))
