"""BPE encoding and decoding (operator 4) by a tokenization automaton.

The driver compiles the merges of a tokenizer file, in rank order, into a deterministic automaton over tokens. A state
is what the last token leaves open at its right end, an arc is a token. The gadget of a merge (u, v) -> w makes w an arc
and closes every passage from a token that ends in a live u to one that begins with a live v: w must be read there
instead. After the last gadget exactly one path of arcs reads a pre-split word, its BPE encoding, and so it is for every
beginning of a word: a word is read once, symbol by symbol, and where it has been read to is told by one arc, the last of that path. Tokens with equal ends
share a row or a column of the table of passages, which takes one bit a pair (20 MB for 49,000 merges); it is broadcast,
for its size follows from the vocabulary alone. The arcs that end at a place come from the transitions of a second table, of
the spellings with their suffixes. Texts are decoded by emitting the labels of their arcs, joined by blanks.

Normaliser, split pattern, special tokens and end-of-word suffix are read from the file; a file that asks for anything
else is refused with a ValueError, as is one whose vocabulary cannot spell every byte.

Defined cases: null text is empty: no tokens and an empty decoded text; special tokens in a text are their own ids;
repeated rows are encoded each; the extra columns of `encode_decode` are those named in keep, but for its own names.
"""

from __future__ import annotations

import json
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, spread, table

#: Chunks of text whose encoding a task keeps: so many new ones at most, and as many of those before.
KEPT = 200_000
#: Words of more symbols are read one by one, shorter ones together.
LONG = 256
#: White space of Unicode, as a body of character classes of regular expressions.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: What str.split takes for white space beside SPACE.
SEPARATORS = "\x1c\x1d\x1e\x1f"


def class_of(category: str) -> str:
    """A regular-expression class body of all characters of a general category's first letter."""
    out, start = [], None
    for c in range(0x110001):
        inside = c < 0x110000 and unicodedata.category(chr(c))[0] == category
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(re.escape(chr(start)) + ("-" + re.escape(chr(c - 1)) if c - 1 > start else ""))
            start = None
    return "".join(out)


def byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies: itself where printable, else from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def checked(spec: dict) -> str:
    """The split pattern of a tokenizer file of the kind `words with an end-of-word suffix`; ValueError for any other."""
    model, pre = spec["model"], spec["pre_tokenizer"] or {}
    steps = [(x["type"], x.get("pattern"), x.get("content")) for x in (spec["normalizer"] or {}).get("normalizers", [])]
    split, *letters = pre.get("pretokenizers") or [{}]
    plain = not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
    fine = {
        "normalizer": steps == [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)],
        "pre_tokenizer": split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert") and "Regex" in split.get("pattern", {})
        and [(x["type"], x["add_prefix_space"], x["use_regex"]) for x in letters] == [("ByteLevel", False, False)],
        "model": model["type"] == "BPE" and bool(model.get("end_of_word_suffix")) and plain,
        "decoder": spec.get("decoder") is None,
        "added_tokens": not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]),
    }
    if unknown := [name for name, good in fine.items() if not good]:
        raise ValueError(f"tokenizer file of another kind: {', '.join(unknown)}")
    return split["pattern"]["Regex"]


class Automaton:
    """The automaton of a tokenizer file, compiled; plain lists, dictionaries and bytes, so that it can be broadcast."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.pattern, model = checked(spec), spec["model"]
        vocab, self.suffix = model["vocab"], model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.labels = {i: t for t, i in [*vocab.items(), *self.special.items()]}
        letters = byte_letters()
        self.letters = {b: c for b, c in enumerate(letters) if chr(b) != c}
        # The alphabet: a byte's letter, or the same at a word's end (moved to a private plane).
        self.final = {c: chr(0xF0000 + ord(c)) for c in letters}
        if missing := [t for c in letters for t in (c, c + self.suffix) if t not in vocab]:
            raise ValueError(f"tokens missing for bytes: {missing}")
        merges = [(vocab[u], vocab[v], vocab[u + v]) for u, v in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])]
        arcs = [vocab[t] for c in letters for t in (c, c + self.suffix)] + [w for _, _, w in merges]
        self.spelled = {t: self._symbols(self.labels[t]) for t in arcs}
        self._trie()
        self._passages(arcs, merges)

    def _symbols(self, token: str) -> str:
        if token.endswith(self.suffix) and len(token) > len(self.suffix):
            head = token[: -len(self.suffix)]
            return head[:-1] + self.final[head[-1]]
        return token

    def _trie(self) -> None:
        """Transitions of spellings; of each state the state of its longest proper suffix and the longest token it ends in; of each token the next shorter one it ends in."""
        self.step: list[dict[str, int]] = [{}]
        own: dict[int, int] = {}
        for token, symbols in self.spelled.items():
            at = 0
            for c in symbols:
                nxt = self.step[at].get(c)
                if nxt is None:
                    nxt = self.step[at][c] = len(self.step)
                    self.step.append({})
                at = nxt
            own[at] = token
        self.fail, self.ends = [0] * len(self.step), [-1] * len(self.step)
        level = list(self.step[0].values())
        for at in level:
            self.ends[at] = own.get(at, -1)
        while level:  # level by level, so that suffixes are known
            after = []
            for at in level:
                for c, to in self.step[at].items():
                    f = self.fail[at]
                    while f and c not in self.step[f]:
                        f = self.fail[f]
                    self.fail[to] = self.step[f].get(c, 0)
                    self.ends[to] = own.get(to, self.ends[self.fail[to]])
                    after.append(to)
            level = after
        self.shorter = {token: self.ends[self.fail[at]] for at, token in own.items()}

    def _passages(self, arcs: list[int], merges: list[tuple[int, int, int]]) -> None:
        """The table of closed passages, by the merges' gadgets in rank order.

        At either end of a token stand its outer parts, each live until the merge that took it up (the token itself for
        good). Of overlapping pairs of one rank the left one wins, so a right part must be live at that rank, a left one before.
        """
        import numpy as np

        of_u, of_v, known = defaultdict(list), defaultdict(list), set()
        right = {t: ((t, len(merges)),) for t in arcs}
        left = dict(right)
        for k, (u, v, w) in enumerate(merges):
            if (u, v) not in known:
                known.add((u, v))
                of_u[u].append(k)
                of_v[v].append(k)
            right[w] = ((w, len(merges)), (v, k), *right[v][1:])
            left[w] = ((w, len(merges)), (u, k), *left[u][1:])

        def classes(ends, ranks, gone):
            """Tokens with parts live for the same merges are one class; for each part its classes with their numbers of such merges."""
            numbers, by_token, by_part = {}, {}, defaultdict(list)
            for t, parts in ends.items():
                key = tuple((p, n) for p, until in parts if p in ranks and (n := gone(ranks[p], until)))
                by_token[t] = numbers.setdefault(key, len(numbers))
            for key, i in numbers.items():
                for p, n in key:
                    by_part[p].append((n, i))
            return by_token, {p: [np.array(x) for x in zip(*sorted(found, reverse=True), strict=True)] for p, found in by_part.items()}, len(numbers)

        row_of, rows, n_rows = classes(right, of_u, bisect_left)
        col_of, cols, n_cols = classes(left, of_v, bisect_right)
        width = -(-n_cols // 8)
        closed = np.zeros((n_rows, width), np.uint8)
        seen_u, seen_v = defaultdict(int), defaultdict(int)
        for k, (u, v, _) in enumerate(merges):
            if (u, v) not in known:
                continue
            known.discard((u, v))
            (n, row), (m, col) = rows[u], cols[v]
            row, col = row[n > seen_u[u]], col[m > seen_v[v]]
            seen_u[u] += 1
            seen_v[v] += 1
            line = np.zeros(8 * width, np.uint8)
            line[col] = 1
            closed[row] |= np.packbits(line, bitorder="little")
        self.closed = closed.tobytes()
        self.row = {t: i * width * 8 for t, i in row_of.items()}
        self.col = col_of
        self.size = {t: len(s) for t, s in self.spelled.items()}


class Encoder:
    """Encodes texts by a compiled automaton; what it has encoded it keeps, within bounds."""

    def __init__(self, automaton: Automaton):
        import numpy as np

        self.auto = a = automaton
        pattern = a.pattern.replace(r"\p{L}", class_of("L")).replace(r"\p{N}", class_of("N")).replace(r"\s", SPACE)
        self.split = re.compile(pattern).findall
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(a.special, key=len, reverse=True))) + ")") if a.special else None
        self.chunks: dict[str, tuple[bytes, str]] = {}
        self.before: dict[str, tuple[bytes, str]] = {}
        self.words: dict[str, tuple[bytes, str]] = {}
        # The transitions as one sorted table, symbols being numbered from 1 in order of their codes.
        self.symbols = np.array(sorted({ord(c) for x in a.step for c in x}))
        self.width = len(self.symbols) + 1
        arcs = sorted((at * self.width + self._number(ord(c)), to) for at, x in enumerate(a.step) for c, to in x.items())
        self.keys, self.to = (np.array(x) for x in zip(*arcs, strict=True))
        self.fail, self.ends = np.array(a.fail), np.array(a.ends)
        top = max(a.labels) + 1
        self.row, self.col, self.size, self.shorter = (np.array([x.get(t, -1) for t in range(top)], np.int64) for x in (a.row, a.col, a.size, a.shorter))
        self.closed = np.frombuffer(a.closed, np.uint8)

    def _number(self, codes):
        return self.symbols.searchsorted(codes) + 1

    def _read(self, state, symbol):
        """The states after a symbol: of the longest suffix of what was read that begins some token."""
        import numpy as np

        out, open_ = np.zeros(len(state), np.int64), np.arange(len(state))
        while len(open_):
            key = state * self.width + symbol
            i = np.minimum(self.keys.searchsorted(key), len(self.keys) - 1)
            on = self.keys[i] == key
            out[open_[on]] = self.to[i[on]]
            off = ~on
            open_, state, symbol = open_[off], self.fail[state[off]], symbol[off]
        return out

    def paths(self, spelled: list[str]):
        """All tokens, and where each word's begin among them.

        All words are read together, a symbol at a time and never again. What is read so far has one path of open arcs; its
        last arc is the longest token that ends here and to which the passage is open from the last arc at its beginning.
        At the end of a word its arcs are followed back.
        """
        import numpy as np

        # Words stand one after another, with a 0 before each, which no arc reads.
        text = np.frombuffer("".join(["\0" + x for x in spelled]).encode("utf-32-le"), "<u4")
        begin = np.flatnonzero(text == 0)
        text = np.append(np.where(text == 0, 0, self._number(text)), 0)
        ends = np.append(begin[1:], len(text) - 1)
        came = np.full(len(text) + 1, -1)  # the last arc of what is read up to a place
        at, stop, state = begin + 1, ends, np.zeros(len(begin), np.int64)
        while len(at):
            state = self._read(state, text[at])
            token, place = self.ends[state], at + 1
            open_ = np.arange(len(at))
            while len(open_):
                t, p = token[open_], place[open_]
                last = came[p - self.size[t]]
                bit = self.row[last] + self.col[t]
                shut = (last >= 0) & (self.closed[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)
                came[p[~shut]] = t[~shut]
                open_ = open_[shut]
                token[open_] = self.shorter[token[open_]]
            going = place < stop
            at, stop, state = place[going], stop[going], state[going]
        found = np.zeros(len(came), bool)
        at, first = ends, begin + 1
        while len(at):
            found[at] = True
            at = at - self.size[came[at]]
            going = at > first
            at, first = at[going], first[going]
        return came[found], np.cumsum(found)[begin]

    def path(self, symbols) -> list[int]:
        """The same for one long word."""
        a, n = self.auto, len(symbols)
        step, fail, ends, closed, row, col, size, shorter = a.step, a.fail, a.ends, a.closed, a.row, a.col, a.size, a.shorter
        came, state = [-1] * (n + 1), 0
        for i in range(n):
            c = symbols[i]
            while c not in step[state]:
                state = fail[state]
            state = step[state][c]
            token = ends[state]
            while (last := came[i + 1 - size[token]]) >= 0 and closed[(bit := row[last] + col[token]) >> 3] >> (bit & 7) & 1:
                token = shorter[token]
            came[i + 1] = token
        out, at = [], n
        while at:
            out.append(came[at])
            at -= size[came[at]]
        return out[::-1]

    def _learn_words(self, words: set[str]) -> None:
        import numpy as np

        a, labels = self.auto, self.auto.labels
        short, spelled = [], []
        for w in words:
            x = w if w.isascii() and w.isprintable() else w.encode("utf-8").decode("latin-1").translate(a.letters)
            x = x[:-1] + a.final[x[-1]]
            if len(x) <= LONG:
                short.append(w)
                spelled.append(x)
            else:
                ids = self.path(x)
                self.words[w] = np.array(ids, "<u4").tobytes(), " ".join([labels[i] for i in ids])
        ids, cuts = self.paths(spelled) if spelled else (np.zeros(0, np.int64),) * 2
        packed, said, cuts = ids.astype("<u4").tobytes(), [labels[i] for i in ids.tolist()], [*cuts.tolist(), len(ids)]
        for w, i, j in zip(short, cuts[:-1], cuts[1:], strict=True):
            self.words[w] = packed[4 * i : 4 * j], " ".join(said[i:j])

    def learn(self, wanted: set[str]) -> None:
        """Encodes chunks without white space: the words that the pattern finds in each."""
        chunks = wanted.difference(self.chunks)
        if len(self.chunks) + len(chunks) > KEPT:
            self.before, self.chunks, chunks = self.chunks, {}, wanted
        new = []
        for c in chunks:
            if (made := self.before.get(c)) is not None:
                self.chunks[c] = made
            else:
                new.append((c, self.split(c)))
        words = {w for _, found in new for w in found}
        missing = words.difference(self.words)
        if len(self.words) + len(missing) > KEPT:
            self.words, missing = {}, words
        self._learn_words(missing)
        known = self.words
        for c, words in new:
            if len(words) == 1:
                self.chunks[c] = known[words[0]]
            else:
                made = [known[w] for w in words]
                self.chunks[c] = b"".join([x for x, _ in made]), " ".join([x for _, x in made])

    def cut(self, text: str) -> list[str]:
        """A text's chunks without white space, and its special tokens; no match of the pattern holds white space."""
        if self.specials is not None and (pieces := self.specials.split(text))[1:]:
            return [c for p in pieces for c in ([p] if p in self.auto.special else self.plain(p))]
        return self.plain(text)

    def plain(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower-cased letter by letter, without regard to a word's end
        text = text.lower()
        return re.findall(f"[^{SPACE}]+", text) if any(c in text for c in SEPARATORS) else text.split()

    def encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """For each text its ids as little-endian 32-bit integers, and the decoded text; every distinct chunk is encoded once."""
        out, cut, size = [], [], 0
        for i, text in enumerate(texts):
            cut.append(self.cut(text))
            size += len(cut[-1])
            if size > KEPT // 2 or i == len(texts) - 1:
                out += self._encode(cut)
                cut, size = [], 0
        return out

    def _encode(self, cut: list[list[str]]) -> list[tuple[bytes, str]]:
        special = self.auto.special
        self.learn(set().union(*cut).difference(special))
        known = self.chunks
        out = []
        for chunks in cut:
            found = [known[c] if c in known else (special[c].to_bytes(4, "little"), c) for c in chunks] if not special.keys().isdisjoint(chunks) else list(map(known.__getitem__, chunks))
            out.append((b"".join([x for x, _ in found]), " ".join([x for _, x in found if x])))
        return out


def encode_decode(docs: DataFrame, tokenizer: str, keep=("doc_id",)) -> DataFrame:
    """Rows (keep..., n_tokens, token_ids, decoded), one per input row; token_ids is the ids as little-endian 32-bit integers."""
    keep = [c for c in keep if c not in ("n_tokens", "token_ids", "decoded")]
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for c in keep for f in docs.schema if f.name == c]

    compiled = docs.sparkSession.sparkContext.broadcast(Automaton(tokenizer))

    def run(batches):
        import pyarrow as pa

        encoder = held(("bpe", tokenizer), lambda: Encoder(compiled.value))
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            for at in range(0, batch.num_rows, 512):  # small batches out: tokens and labels are larger than the text
                made = encoder.encode([t or "" for t in column.slice(at, 512).to_pylist()])
                kept = [batch.column(i).slice(at, 512) for i in range(batch.num_columns - 1)]
                cols = [pa.array([len(x) // 4 for x, _ in made], pa.int64()), pa.array([x for x, _ in made], pa.binary()), pa.array([x for _, x in made], pa.string())]
                yield pa.RecordBatch.from_arrays([*kept, *cols], names=[*batch.schema.names[:-1], "n_tokens", "token_ids", "decoded"])

    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, ", ".join([*kinds, "n_tokens long, token_ids binary, decoded string"]))


def op4_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return found.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


SQL = None
