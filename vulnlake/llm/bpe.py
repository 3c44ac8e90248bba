"""Byte-pair encoding over Spark: a prefix-sharing trie encoder, a rank-synchronous counter and an id encoder.

All three read texts in Arrow batches inside `mapInArrow`, need no shuffle, and keep per task a dictionary of
the chunks between blanks that it has met, about `CACHE_CHUNKS` at most.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from vulnlake.llm.common import id_and_text, slices, tokenizer_path

CACHE_CHUNKS = 200_000
#: Bytes of text whose new words go into one trie.
TRIE_BYTES = 6 << 20

#: The split pattern of byte-level BPE, and that of the lower-casing word BPE.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def special_tokens(spec: dict) -> dict[str, int]:
    return {t["content"]: t["id"] for t in spec.get("added_tokens", [])}


def splitter(specials: Iterable[str]) -> re.Pattern:
    """Splits a text around its special tokens, which stay as parts of their own."""
    longest_first = sorted(specials, key=lambda s: (-len(s), s))
    return re.compile("(" + "|".join(map(re.escape, longest_first)) + ")" if longest_first else r"((?!))")


# ---------------------------------------------------------------- trie encoder


class TrieBpe:
    """Encodes words by walking a trie of them.

    The encoding of a string by ranked merges is fixed by the last token of each of its prefixes: it is the one
    token that ends there and that, put behind the last token of the prefix before it, the merges leave apart.
    Walking the trie depth-first carries these last tokens down, so that a prefix shared by many words is worked
    out once. A word's end is a symbol of its own (the last letter with the end-of-word mark).
    """

    PAIRS = 500_000

    def __init__(self, spec: dict):
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.shown = {self.folded(token): token for token in model["vocab"]}
        self.inner = {self.folded(token): str(i) for token, i in model["vocab"].items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.ranks = {(self.folded(a), self.folded(b)): r for r, (a, b) in enumerate(pairs)}
        self.made = {a + b: (r, a, b) for (a, b), r in self.ranks.items()}
        self.starts = {token[:n] for token in self.inner for n in range(len(token) + 1)}
        self.steps: dict[str, dict] = {}  # start of a token that a prefix ends in -> symbol -> the same one further
        self.letters = byte_letters()
        self.after: dict[str, dict[str, bool]] = {}  # last token -> next token -> whether merges leave them apart
        self.pairs = 0

    def folded(self, token: str) -> str:
        """With the end-of-word mark folded into the last letter, as one symbol."""
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            token = token[: -len(self.suffix)]
            return token[:-1] + chr(ord(token[-1]) + 0x10000)
        return token

    def symbols(self, word: str) -> str:
        s = word if word.isascii() and word.isprintable() else "".join([self.letters[b] for b in word.encode()])
        return s[:-1] + chr(ord(s[-1]) + 0x10000) if self.suffix else s

    def merged(self, s: str) -> list[str]:
        """The plain merge loop; used on a token to learn whether merges lead to it."""
        parts = list(s)
        while len(parts) > 1:
            rank, at = min((self.ranks.get(p, 1 << 30), i) for i, p in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 30:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def meet(self, left: str, right: str) -> bool:
        """Whether merges cross the border of two tokens.

        Merges are undone from the last one made, on the left token's right edge or the right token's left edge. The
        tokens that then face each other would have merged if their rank came before the merge undone; of equal ranks
        the one further left comes first.
        """
        before = 1 << 30
        while True:
            if self.ranks.get((left, right), before) < before:
                return True
            made_left, made_right = self.made.get(left), self.made.get(right)
            if made_right and (not made_left or made_right[0] >= made_left[0]):
                before, right = made_right[0] + 1, made_right[1]
            elif made_left:
                before, left = made_left[0], made_left[2]
            else:
                return False

    def stays(self, left: str, right: str) -> bool:
        self.pairs += 1
        return not self.meet(left, right) if left else self.merged(right) == [right]

    def step(self, ends_in: str, symbol: str) -> tuple[dict, str, list[tuple[str, int]]]:
        """From the longest token start that a prefix ends in, by a symbol: steps from there, it, and the tokens it ends in."""
        longer = ends_in + symbol
        while longer not in self.starts:
            longer = longer[1:]
        tokens = [(longer[k:], len(longer) - k) for k in range(len(longer)) if longer[k:] in self.inner]
        found = self.steps.setdefault(ends_in, {})[symbol] = (self.steps.setdefault(longer, {}), longer, tokens)
        return found

    def encode(self, words: Iterable[str]) -> dict[str, tuple[str, str]]:
        """Ids and tokens, each joined by blanks, of the distinct words.

        Sorted words are their trie in depth-first order: what a word shares with the one before it is the path to their
        common node, whose states stay; only the nodes below are worked out.
        """
        if self.pairs > self.PAIRS:
            self.after, self.pairs = {}, 0
        inner, after = self.inner, self.after
        found: dict[str, tuple[str, str]] = {}
        # of the prefix of each length on the path: its last token, what is known of tokens behind that, and the token
        # starts it ends in
        last: list[str] = [""]
        known: list[dict[str, bool]] = [after.setdefault("", {})]
        state: list[tuple[dict, str]] = [(self.steps.setdefault("", {}), "")]
        before = ""
        for path, word in sorted((self.symbols(w), w) for w in words):
            size = len(path)
            shared, beyond = 0, min(size, len(before)) + 1
            while beyond - shared > 1:
                middle = (shared + beyond) // 2
                if path[:middle] == before[:middle]:
                    shared = middle
                else:
                    beyond = middle
            del last[shared + 1 :], known[shared + 1 :], state[shared + 1 :]
            steps, ends_in = state[-1]
            for depth, symbol in enumerate(path[shared:], shared + 1):
                steps, ends_in, tokens = steps.get(symbol) or self.step(ends_in, symbol)
                for token, n in tokens:
                    stays = known[depth - n].get(token)
                    if stays is None:
                        stays = known[depth - n][token] = self.stays(last[depth - n], token)
                    if stays:
                        break
                else:
                    raise ValueError(f"no token ends {path[:depth]!r}")
                last.append(token)
                beside = after.get(token)
                if beside is None:
                    beside = after[token] = {}
                known.append(beside)
                state.append((steps, ends_in))
            before, depth, ids, shown = path, size, [], []
            while depth:
                token = last[depth]
                ids.append(inner[token])
                shown.append(self.shown[token])
                depth -= len(token)
            found[word] = (" ".join(ids[::-1]), " ".join(shown[::-1]))
        return found


def lowered(text: str) -> str:
    """NFC, then lower case letter by letter (a final sigma is no special case)."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def trie_rows(batches: Iterator[pa.RecordBatch], vocabulary: str) -> Iterator[pa.RecordBatch]:
    with open(tokenizer_path(vocabulary)) as f:
        spec = json.load(f)
    bpe, specials = TrieBpe(spec), special_tokens(spec)
    around, words = splitter(specials), regex.compile(WORD_PATTERN)
    odd = re.compile("[\x1c-\x1f]")  # blanks to str.split(), but not to the pattern
    ids_of, shown_of = {s: str(i) for s, i in specials.items()}, {s: s for s in specials}

    def chunks(text: str) -> list[str]:
        return words.findall(text) if odd.search(text) else text.split()

    def learn(new: set[str]) -> None:
        parts = {c: [c] if c.isalpha() else words.findall(c) for c in new}
        wanted = {w for ws in parts.values() for w in ws}
        own = {w: (ids_of[w], shown_of[w]) for w in wanted if w in ids_of}
        own |= bpe.encode(wanted.difference(own))
        for c, ws in parts.items():
            if len(ws) == 1:
                ids_of[c], shown_of[c] = own[ws[0]]
            else:
                several = [own[w] for w in ws]
                ids_of[c], shown_of[c] = " ".join([g[0] for g in several]), " ".join([g[1] for g in several])

    for batch in batches:
        for part in slices(batch, "text", TRIE_BYTES):
            texts = []
            for t in part["text"].to_pylist():
                segments = around.split(t or "")
                if len(segments) == 1:
                    texts.append(chunks(lowered(segments[0])))
                else:
                    texts.append([c for k, s in enumerate(segments) for c in ([s] if k % 2 else chunks(lowered(s)))])
            new = set().union(*texts).difference(ids_of)
            learn(new)
            ids = [" ".join(map(ids_of.__getitem__, cs)) for cs in texts]
            shown = [" ".join(map(shown_of.__getitem__, cs)) for cs in texts]
            counts = [i.count(" ") + 1 if i else 0 for i in ids]
            forget(ids_of, new)
            forget(shown_of, new)
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(shown, pa.string())],
                names=["doc_id", "n_tokens", "ids", "decoded"],
            )


def encode_words(docs: DataFrame, vocabulary: str = "word_bpe_49k.json") -> DataFrame:
    """`doc_id, n_tokens, ids, decoded`: ids of every whole text (decimal, joined by blanks), and their decoded text.

    A null or empty text has no tokens and two empty strings. Repeated rows stay repeated, an empty table gives an empty one,
    a very long text is encoded whole in its task; other columns are left out.
    """
    schema = "doc_id long, n_tokens long, ids string, decoded string"
    return id_and_text(docs).mapInArrow(lambda batches: trie_rows(batches, vocabulary), schema)


# ---------------------------------------------------------------- byte-level chunks


def blank_chunks(text: str, whole: regex.Pattern) -> list[str]:
    """Parts of a text that byte-level BPE treats one by one.

    A single blank always starts a new pre-token, so a text can be cut in front of each; where blanks follow each
    other that is not so, and the text is cut into pre-tokens by the pattern.
    """
    if "  " in text:
        return whole.findall(text)
    head, *rest = text.split(" ")
    return [head, *[" " + r for r in rest]] if head else [" " + r for r in rest]


class RankMerger:
    """Counts the symbols that are left of many pre-tokens, all merged at once in ragged arrays."""

    DONE = np.int64(1 << 40)

    def __init__(self, spec: dict):
        vocab = spec["model"]["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order.astype(np.int64)
        self.product = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.first = np.array([vocab[c] for c in byte_letters()], np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], self.DONE)

    def count(self, tokens: list[bytes]) -> np.ndarray:
        """Symbols left of each token (none is empty)."""
        length = np.array([len(t) for t in tokens], np.int64)
        result, alive = np.ones(len(tokens), np.int64), np.arange(len(tokens))
        symbol = self.first[np.frombuffer(b"".join(tokens), np.uint8)]
        while len(alive):
            start = np.concatenate([[0], np.cumsum(length)[:-1]])
            rank = np.full(len(symbol), self.DONE)
            rank[:-1] = self.ranks(symbol[:-1], symbol[1:])
            rank[start + length - 1] = self.DONE  # a last symbol has no pair
            lowest = np.minimum.reduceat(rank, start)
            result[alive] = length
            hit = (rank == np.repeat(lowest, length)) & (rank < self.DONE)
            at = np.flatnonzero(hit)
            if len(at):
                # of overlapping pairs (a symbol in a row) every other one is merged, from the left
                fresh = np.flatnonzero(np.concatenate([[True], np.diff(at) > 1]))
                run = np.arange(len(at)) - np.repeat(fresh, np.diff(np.append(fresh, len(at))))
                at = at[run % 2 == 0]
                symbol[at] = self.product[rank[at]]
                stay = np.ones(len(symbol), bool)
                stay[at + 1] = False
                owner = np.repeat(np.arange(len(alive)), length)
                length = length - np.bincount(owner[at], minlength=len(alive))
                symbol = symbol[stay]
            going = (lowest < self.DONE) & (length > 1)
            result[alive] = length
            symbol = symbol[np.repeat(going, length)]
            alive, length = alive[going], length[going]
        return result


def count_rows(batches: Iterator[pa.RecordBatch], vocabulary: str) -> Iterator[pa.RecordBatch]:
    with open(tokenizer_path(vocabulary)) as f:
        spec = json.load(f)
    merger, specials, whole = RankMerger(spec), special_tokens(spec), regex.compile(BYTE_PATTERN)
    around, known = splitter(specials), dict.fromkeys(specials, 1)
    for batch in batches:
        for part in slices(batch, "text"):
            texts = []
            for t in part["text"].to_pylist():
                segments = around.split(t or "")
                texts.append([c for k, s in enumerate(segments) for c in ([s] if k % 2 else blank_chunks(s, whole))])
            new = list({c for cs in texts for c in cs if c not in known})
            cut = [whole.findall(c) for c in new]
            tokens = list({w for ws in cut for w in ws})
            size = dict(zip(tokens, merger.count([w.encode() for w in tokens]).tolist())) if tokens else {}
            known.update((c, sum([size[w] for w in ws])) for c, ws in zip(new, cut))
            counts = [sum([known[c] for c in cs]) for cs in texts]
            forget(known, new)
            sizes = pa.compute.fill_null(pa.compute.cast(pa.compute.binary_length(part["text"]), pa.int64()), 0)
            yield pa.RecordBatch.from_arrays([part["doc_id"], sizes, pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])


def count_tokens(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """`doc_id, n_bytes, n_tokens` of every whole text; null and empty texts count 0.

    Repeated rows stay repeated, an empty table gives an empty one, a very long text is counted whole in its task; other
    columns are left out.
    """
    return id_and_text(docs).mapInArrow(lambda batches: count_rows(batches, vocabulary), "doc_id long, n_bytes long, n_tokens long")


class IdPacker:
    """Ids of whole texts as little-endian 32-bit bytes; each chunk between blanks is encoded once.

    The vocabulary file is the tokenizers library's; short strings go through tiktoken with the ranks of that file, which
    gives the same ids (its ids are ranks) at a third of the cost of a call.
    """

    def __init__(self, vocabulary: str):
        import tiktoken

        with open(tokenizer_path(vocabulary)) as f:
            spec = json.load(f)
        byte = {c: b for b, c in enumerate(byte_letters())}
        ranks = {bytes([byte[c] for c in token]): i for token, i in spec["model"]["vocab"].items()}
        encode = tiktoken.Encoding("byte-level", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.specials = {s: i.to_bytes(4, "little") for s, i in special_tokens(spec).items()}
        self.around, self.whole = splitter(self.specials), regex.compile(BYTE_PATTERN)
        self.bare, self.after_blank = Packed(encode, ""), Packed(encode, " ")

    def pack(self, text: str | None) -> bytes:
        out: list[bytes] = []
        for k, segment in enumerate(self.around.split(text or "")):
            if k % 2:
                out.append(self.specials[segment])
            elif "  " in segment:
                out += map(self.bare.__getitem__, self.whole.findall(segment))
            else:
                head, *rest = segment.split(" ")
                out += [self.bare[head], *map(self.after_blank.__getitem__, rest)]
        return b"".join(out)


class Packed(dict):
    """Ids of chunks as bytes; about the first `CACHE_CHUNKS` different ones are remembered, the frequent among them."""

    def __init__(self, encode: Callable[[str], list[int]], before: str):
        self.encode, self.before = encode, before

    def __missing__(self, chunk: str) -> bytes:
        ids = array("I", self.encode(self.before + chunk)).tobytes()
        if len(self) < CACHE_CHUNKS:
            self[chunk] = ids
        return ids


def forget(known: dict, new: Iterable[str]) -> None:
    """Once enough is remembered, what came last goes again: frequent chunks come early."""
    if len(known) > CACHE_CHUNKS:
        for c in new:
            del known[c]
