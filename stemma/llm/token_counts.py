"""Edit-aware token counts: a segment tree of pre-token runs for each document.

A byte-level BPE never merges across pre-tokens.  A text is cut into leaves of
about ``LEAF`` code points at borders that are those of pre-tokens whatever
stands elsewhere: ahead of white space, and between a sentence mark and a letter
or digit, so that texts without spaces are cut as well.  Each leaf is a run of
whole pre-tokens that can be encoded alone.  A document keeps the code points
and tokens of its leaves and the sums of every subtree.

An edit finds its leaves by walking down the code point sums.  The leaves it
touches, and the neighbours whose border lies within one code point of it (the
boundary context on which their cut rests), are re-encoded as one region; the
region's new leaves take the places of the old ones, and only the sums above
them are updated.  New text that has no place of its own joins the region's last
leaf; a tree is dealt out anew only when such a leaf has grown to ``GROWN``
leaves' size, for which that much text was put in.

Defined results: a null or empty text has one leaf of nothing; a run of letters
without any mark or space is one leaf, as it is one pre-token; edit positions
beyond the text's end are moved to it, negative and null ones count as 0, and a
null insertion as empty; edits of one row apply one after another; a null tree is
counted anew; repeated rows are counted alike; an empty table gives no rows;
further columns are kept.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stemma.llm.tokens import encoder

LEAF, GROWN = 1024, 4
#: Marks that are in no pre-token with what follows them, unless that is a mark as well.
_MARKS = ".,;:!?。、，！？；：」』）】…"
#: Letters and digits that all versions of the character tables know as such.
_LETTERS = "0-9A-Za-zÀ-ÖØ-öø-ɏΑ-ΡΣ-ωА-яぁ-ゔァ-ヺ一-龥"
_CUT = re.compile(rf"(?<=[\w{_MARKS})\]\"])(?=[ \t\r\n])|(?<=[{_MARKS}])(?=[{_LETTERS}])")


def leaf_texts(text: str, size: int = LEAF) -> list[str]:
    """Runs of whole pre-tokens of ``size`` code points or a little more each."""
    out, at = [], 0
    while (found := _CUT.search(text, at + size)) is not None:
        out.append(text[at : found.start()])
        at = found.start()
    return [*out, text[at:]]


class Tree:
    """A segment tree over leaves: code points and tokens of each, and the sums above them.

    Node 1 is the root and node ``k`` has the children ``2k`` and ``2k + 1``.
    """

    def __init__(self, chars: list[int], tokens: list[int]):
        self.width = 1 << max(0, len(chars) - 1).bit_length()
        self.leaves = len(chars)
        pad = [0] * (self.width - self.leaves)
        self.chars, self.tokens = [0] * self.width + chars + pad, [0] * self.width + tokens + pad
        for k in range(self.width - 1, 0, -1):
            self._sum(k)

    def _sum(self, k: int) -> None:
        self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
        self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    @classmethod
    def of(cls, text: str, encode) -> Tree:
        parts = leaf_texts(text)
        return cls([len(p) for p in parts], [len(encode(p)) for p in parts])

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds code point ``at`` (the last one, beyond the end) and where it starts."""
        k, start = 1, 0
        while k < self.width:
            k *= 2
            if at >= start + self.chars[k] and self.chars[k + 1]:
                start += self.chars[k]
                k += 1
        return k - self.width, start

    def replace(self, first: int, last: int, chars: list[int], tokens: list[int]) -> None:
        """Put new leaves in place of leaves ``first`` to ``last``; only the sums above them change.

        Of more leaves than there are places, the further ones join the last.
        """
        places = last - first + 1
        if len(chars) > places:
            chars, tokens = [*chars[: places - 1], sum(chars[places - 1 :])], [*tokens[: places - 1], sum(tokens[places - 1 :])]
        touched = set()
        for n, k in enumerate(range(self.width + first, self.width + last + 1)):
            self.chars[k], self.tokens[k] = (chars[n], tokens[n]) if n < len(chars) else (0, 0)
            touched.add(k >> 1)
        while touched and touched != {0}:
            for k in touched:
                if k:
                    self._sum(k)
            touched = {k >> 1 for k in touched}

    def deal(self, first: int, last: int, chars: list[int], tokens: list[int]) -> None:
        """Build the tree anew, with new leaves in place of leaves ``first`` to ``last``, and without empty ones."""
        before, after = slice(self.width, self.width + first), slice(self.width + last + 1, self.width + self.leaves)
        leaves = zip(self.chars[before] + chars + self.chars[after], self.tokens[before] + tokens + self.tokens[after], strict=True)
        kept = [x for x in leaves if x[0]] or [(0, 0)]
        self.__init__([c for c, _ in kept], [t for _, t in kept])

    def edit(self, text: str, start: int, delete: int, insert: str, encode) -> tuple[str, int]:
        """Apply one edit; the new text, and how many code points were encoded again."""
        start = min(max(start, 0), len(text))
        end = min(start + max(delete, 0), len(text))
        # One code point of context on either side decides about the cuts there.
        first, left = self.find(max(start - 1, 0))
        last, right = self.find(min(end + 1, max(len(text) - 1, 0)))
        right += self.chars[self.width + last]
        region = text[left:start] + insert + text[end:right]
        parts = leaf_texts(region)
        chars, tokens = [len(p) for p in parts], [len(encode(p)) for p in parts]
        crowded = len(parts) > last - first + 1 and sum(chars[last - first :]) > GROWN * LEAF
        (self.deal if crowded else self.replace)(first, last, chars, tokens)
        return text[:start] + insert + text[end:], len(region)


TREE = T.StructType([T.StructField("leaf_chars", T.ArrayType(T.IntegerType())), T.StructField("leaf_tokens", T.ArrayType(T.IntegerType()))])


def _mapped(df: DataFrame, fields: list[T.StructField], row):
    """``df`` with more columns that ``row`` makes from each record batch's columns, by name."""
    schema = T.StructType([*df.schema.fields, *fields])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        types = to_arrow_schema(T.StructType(fields))
        for batch in batches:
            made = list(zip(*map(row, zip(*(batch.column(c).to_pylist() for c in names), strict=True)), strict=True)) or [[] for _ in fields]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(c, f.type) for c, f in zip(made, types, strict=True))],
                names=[*batch.schema.names, *types.names],
            )

    names = row.columns
    return df.mapInArrow(run, schema)


def count_tokens(df: DataFrame, tokenizer: str, *, text_col: str = "text") -> DataFrame:
    """``df`` with ``n_tokens`` and ``token_tree``, the leaves from which a tree is rebuilt without encoding.

    Columns of these names are replaced.
    """
    df = df.drop("n_tokens", "token_tree")

    def row(values):
        tree = Tree.of(values[0] or "", encoder(tokenizer).encode)
        own = slice(tree.width, tree.width + tree.leaves)
        return tree.tokens[1], {"leaf_chars": tree.chars[own], "leaf_tokens": tree.tokens[own]}

    row.columns = [text_col]
    return _mapped(df, [T.StructField("n_tokens", T.LongType()), T.StructField("token_tree", TREE)], row)


def apply_edits(df: DataFrame, tokenizer: str, *, text_col: str = "text", edits_col: str = "edits") -> DataFrame:
    """``df`` after its edits, an array of (start, delete, insert): text, ``token_tree`` and ``n_tokens`` are updated.

    Adds ``reencoded_chars``, what had to be encoded again, in place of a column of that name.
    """
    df = df.drop("reencoded_chars")
    others = [c for c in df.columns if c not in (text_col, "token_tree", "n_tokens")]

    def row(values):
        text, leaves, edits = values[0] or "", values[1], values[2] or []
        encode, again = encoder(tokenizer).encode, 0
        known = leaves is not None and leaves["leaf_chars"] and leaves["leaf_tokens"]
        tree = Tree(leaves["leaf_chars"], leaves["leaf_tokens"]) if known else Tree.of(text, encode)
        for e in edits:
            text, n = tree.edit(text, e["start"] or 0, e["delete"] or 0, e["insert"] or "", encode)
            again += n
        own = slice(tree.width, tree.width + tree.leaves)
        return text, {"leaf_chars": tree.chars[own], "leaf_tokens": tree.tokens[own]}, tree.tokens[1], again

    row.columns = [text_col, "token_tree", edits_col]
    made = [T.StructField("__tc_text", T.StringType()), T.StructField("__tc_tree", TREE), T.StructField("__tc_tokens", T.LongType()), T.StructField("reencoded_chars", T.LongType())]
    out = _mapped(df, made, row)
    return out.select(*others, F.col("__tc_text").alias(text_col), F.col("__tc_tree").alias("token_tree"), F.col("__tc_tokens").alias("n_tokens"), "reencoded_chars")
