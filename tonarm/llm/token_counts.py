"""Token counts (operator 13) by rank-synchronous merging of ragged arrays.

Texts are cut into pre-tokens as the tokenizer file says. The distinct new pre-tokens of a batch are laid end to end in
one numpy array of symbols, first of bytes. In every round each sequence applies its lowest-rank pair wherever it stands,
left to right, all sequences at once; ranks are looked up anew only beside merged places, and sequences without a pair
left drop out. What a sequence has then is its number of tokens: ids are never built. That all places of one pair can
be merged at once needs merges whose products are made once and only after their parts; a file without that is refused
with a ValueError, as is one of another kind than byte-level BPE.

A task keeps the counts of pre-tokens it knows (`KEPT`, forgotten together), so memory is bounded; a text is held with its
pre-tokens, so a very long text takes about ten times its own size.

Defined cases: a null text is empty, of no bytes and no tokens; a special token's string inside a text is one token;
repeated rows are counted each, null doc_ids too; an empty table gives no rows. Only the columns named in keep and text
are read, so extra columns of any name do no harm; the operator's own names win over those in keep.
"""

from __future__ import annotations

import json
import re
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_letters
from .common import held, spread, table

#: Pre-tokens whose counts a task keeps; longer ones than LONG bytes are not kept.
KEPT, LONG = 600_000, 64
#: Symbols that are merged together, but for a single longer pre-token.
TOGETHER = 1 << 20
LIMIT = 1_024
NO_RANK = 1 << 30
CONTRACTIONS = "'(?:[stmd]|re|ve|ll)"
#: The split of byte-level files without a pattern of their own; for plain ASCII the same with shorter classes.
SPLIT = CONTRACTIONS + r"| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPLIT_ASCII = CONTRACTIONS + r"| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"


class Merges:
    """Pairs of a tokenizer file by rank, as sorted numpy arrays of about 1 MB."""

    def __init__(self, path: str):
        import numpy as np

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        plain = not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
        fine = {
            "normalizer": spec["normalizer"] is None, "model": model["type"] == "BPE" and plain, "post_processor": spec["post_processor"] is None,
            "pre_tokenizer": pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True),
            "added_tokens": not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]),
        }
        if unknown := [name for name, good in fine.items() if not good]:
            raise ValueError(f"tokenizer file of another kind: {', '.join(unknown)}")
        vocab, letters = model["vocab"], byte_letters()
        self.special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.of_byte = np.array([vocab[c] for c in letters], np.int64)
        made, pairs, products = set(self.of_byte.tolist()), [], []
        for u, v in (m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            a, b, w = vocab[u], vocab[v], vocab[u + v]
            if a not in made or b not in made or w in made:
                raise ValueError(f"a merge out of order: {u} {v}")
            made.add(w)
            pairs.append(a << 32 | b)
            products.append(w)
        self.products, pairs = np.array(products, np.int64), np.array(pairs, np.int64)
        self.ranks = np.argsort(pairs)
        self.pairs = pairs[self.ranks]

    def rank(self, a, b):
        """Ranks of pairs of symbols, NO_RANK where none is merged."""
        import numpy as np

        wanted = a << 32 | b
        at = np.minimum(np.searchsorted(self.pairs, wanted), len(self.pairs) - 1)
        return np.where(self.pairs[at] == wanted, self.ranks[at], NO_RANK)

    def surviving(self, sequences: list[bytes]):
        """The number of symbols that are left of each sequence, none of them empty."""
        import numpy as np

        sizes = np.array([len(s) for s in sequences], np.int64)
        left = sizes.copy()
        symbols = self.of_byte[np.frombuffer(b"".join(sequences), np.uint8)]
        owner = np.repeat(np.arange(len(sequences)), sizes)
        rank = np.full(len(symbols), NO_RANK, np.int64)
        inner = np.flatnonzero(owner[:-1] == owner[1:])
        rank[inner] = self.rank(symbols[inner], symbols[inner + 1])
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.r_[starts, len(symbols)]))
            hits = np.flatnonzero((rank == lowest) & (rank < NO_RANK))
            # Of overlapping places, which follow each other, every second one from the left.
            begins = np.r_[True, np.diff(hits) != 1][: len(hits)]
            begun = hits[np.maximum.accumulate(np.where(begins, np.arange(len(hits)), 0))] if len(hits) else hits
            hits = hits[(hits - begun) % 2 == 0]
            symbols[hits] = self.products[rank[hits]]
            left -= np.bincount(owner[hits], minlength=len(left))
            # Right parts go, and sequences without a pair.
            keep = lowest < NO_RANK
            keep[hits + 1] = False
            place = np.cumsum(keep) - 1
            symbols, owner, rank, hits = symbols[keep], owner[keep], rank[keep], place[hits]
            beside = np.r_[hits, hits[hits > 0] - 1]
            rank[beside] = NO_RANK
            beside = beside[beside < len(symbols) - 1]
            beside = beside[owner[beside] == owner[beside + 1]]
            rank[beside] = self.rank(symbols[beside], symbols[beside + 1])
        return left


class Counter:
    """Counts the tokens of texts; keeps the counts of short pre-tokens."""

    def __init__(self, merges: Merges):
        import regex

        self.merges, self.known = merges, {}
        self.split, self.split_ascii = regex.compile(SPLIT), re.compile(SPLIT_ASCII, re.ASCII)
        self.special = re.compile("(" + "|".join(map(re.escape, merges.special)) + ")") if merges.special else None

    def cut(self, text: str) -> tuple[list[str], int]:
        """A text's pre-tokens, and how many special tokens stand between them."""
        split = self.split_ascii if text.isascii() else self.split
        if self.special is None or not self.special.search(text):
            return split.findall(text), 0
        pieces = self.special.split(text)
        return [w for p in pieces[::2] for w in split.findall(p)], len(pieces) // 2

    def learn(self, words: set[str]) -> dict[str, int]:
        """The counts of words, those that were not known among them."""
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > KEPT:
            self.known, new = {}, list(words)
        new.sort(key=len)
        coded = [w.encode() for w in new]
        long, begin = {}, 0
        ends = list(accumulate(map(len, coded)))
        while begin < len(new):
            base, end = (ends[begin - 1] if begin else 0), begin + 1
            while end < len(new) and ends[end] - base <= TOGETHER:
                end += 1
            for w, s, n in zip(new[begin:end], coded[begin:end], self.merges.surviving(coded[begin:end]).tolist(), strict=True):
                (self.known if len(s) <= LONG else long)[w] = n
            begin = end
        return long

    def count(self, texts: list[str]) -> list[int]:
        cuts = [self.cut(t) for t in texts]
        long = self.learn(set().union(*[words for words, _ in cuts]))
        of = self.known.__getitem__
        if not long:
            return [sum(map(of, words)) + n for words, n in cuts]
        return [sum([long[w] if w in long else of(w) for w in words]) + n for words, n in cuts]


def batched(texts: list[str], limit: int = 1 << 20):
    """Slices (from, to) of texts of about so many characters, one text at least."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def count_tokens(docs: DataFrame, tokenizer: str, keep=("doc_id",)) -> DataFrame:
    """Rows (keep..., n_bytes, n_tokens), one per input row; no row moves."""
    keep = [c for c in keep if c not in ("n_bytes", "n_tokens")]
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for c in keep for f in docs.schema if f.name == c]
    merges = docs.sparkSession.sparkContext.broadcast(Merges(tokenizer))  # about 1 MB: the vocabulary's size alone decides

    def run(batches):
        import pyarrow as pa

        counter = held(("token counts", tokenizer), lambda: Counter(merges.value))
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            counts = [n for i, j in batched(texts) for n in counter.count(texts[i:j])]
            columns = [*batch.columns[:-1], pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "n_bytes", "n_tokens"])

    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, ", ".join([*kinds, "n_bytes long, n_tokens long"]))


def op13_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return found.withColumn("over_limit", F.col("n_tokens") > LIMIT)


#: Merging by rank is beyond SQL.
SQL = None
