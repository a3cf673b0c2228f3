"""Tokens of whole texts by a tokenizer file, piece by piece.

A text is cut where the tokenizer itself always cuts, so pieces can be encoded alone, each
distinct piece once per task. Special strings come out first, as in the library: white space
before one is the end of a stretch. Texts in which libraries may disagree on what white
space is are encoded whole.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from itertools import compress

import numpy as np
from tokenizers import Tokenizer

# The characters of Unicode's White_Space property.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Characters that some versions or engines count as white space.
UNSURE = re.compile("[\x1c-\x1f\u180e\u200b\u2060\ufeff]")
# A word with the space before it; white space but for its last character; one such character.
PIECE = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]")
# Letters after which a full stop or comma always starts a new token.
LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZßàáâäçèéêëìíîïñòóôöùúûüÀÁÂÄÇÈÉÊËÌÍÎÏÑÒÓÔÖÙÚÛÜ")
KEPT_PIECES = 1_000_000  # of a generation; two of them take about 50 MB in a worker
KEPT_LENGTH = 48  # longer pieces are not kept
TOGETHER = 2000
SLAB = 1 << 20


@lru_cache(maxsize=4)
def load(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def kind(path: str) -> str:
    """How texts may be cut for this tokenizer.

    ``bytes``: byte-level pre-tokenizer with its own pattern, no normalizer: cuts at PIECE.
    ``words``: white space is dropped, letters are in lower case and words are runs of letters: see word_pieces.
    ``whole``: nothing is known, texts are encoded whole.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if spec.get("truncation") or spec.get("padding") or spec.get("post_processor"):
        return "whole"
    if any(re.search(r"\s", t["content"]) or not t["content"].startswith("<|") or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
        return "whole"
    cut, normal = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if not normal and cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space"):
        return "bytes"
    steps = cut.get("pretokenizers") or [{}]
    first = steps[0]
    plain = all(n["type"] in ("NFC", "Lowercase") or n["type"] == "Replace" and n["content"] == " " for n in (normal or {}).get("normalizers", []))
    drops = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert")
    joins = all(s.get("type") == "ByteLevel" and not s.get("use_regex") and not s.get("add_prefix_space") for s in steps[1:])
    pattern = (first.get("pattern") or {}).get("Regex", "")
    lowers = any(n["type"] == "Lowercase" for n in (normal or {}).get("normalizers", []))
    letters = "[\\p{L}]+" in pattern and "[^\\s\\p{L}\\p{N}]+" in pattern
    if plain and lowers and letters and drops and joins and not re.search(r"\\s(?![^\[]*\])|[ ]", pattern):
        return "words"
    return "whole"


def longest_special(path: str) -> int:
    return max([0, *(len(t.content) for t in load(path).get_added_tokens_decoder().values())])


@lru_cache(maxsize=4)
def _specials(path: str) -> re.Pattern | None:
    """The special strings, the longest first, as the library takes them."""
    found = sorted((t.content for t in load(path).get_added_tokens_decoder().values() if t.content), key=len, reverse=True)
    return re.compile("(" + "|".join(map(re.escape, found)) + ")") if found else None


def byte_pieces(slab: str, specials: re.Pattern | None) -> list[str]:
    """Pieces of a text for a tokenizer of kind ``bytes``: special strings, and PIECE in the stretches between them."""
    if specials is None or "<|" not in slab:
        return PIECE.findall(slab)
    out: list[str] = []
    for k, part in enumerate(specials.split(slab)):
        out += [part] if k % 2 else PIECE.findall(part)
    return out


class _Run:
    """Pieces by the sorted 64-bit hashes of their text: the length and place of their ids in one buffer."""

    def __init__(self, keys: np.ndarray, lengths: np.ndarray, ids: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys, self.lengths = keys[order], lengths[order]
        self.starts = (np.cumsum(lengths, dtype=np.int64) - lengths)[order] if len(ids) else np.zeros(len(keys), dtype=np.int64)
        self.ids = ids

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are here, and where."""
        if not len(self.keys):
            return np.zeros(len(keys), dtype=bool), np.zeros(0, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = self.keys[at] == keys
        return hit, at[hit]

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and ids, one after the other, of the pieces at these places."""
        lengths = self.lengths[at].astype(np.int64)
        if not len(self.ids):
            return lengths, self.ids
        ends = np.cumsum(lengths)
        return lengths, self.ids[np.repeat(self.starts[at] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]

    def with_more(self, other: _Run) -> _Run:
        lengths, ids = self.take(np.arange(len(self.keys)))
        more, theirs = other.take(np.arange(len(other.keys)))
        return _Run(np.concatenate([self.keys, other.keys]), np.concatenate([lengths, more]), np.concatenate([ids, theirs]))


class Pieces:
    """Encodes lists of pieces, each distinct one of a batch once; results are kept packed.

    About 25 bytes a piece: a young generation in two runs, the small one merged into the
    large one as it grows, and an old one, from which pieces that still come are taken over.
    A full young generation becomes the old one, so memory is bounded and no common piece is
    ever encoded twice. Equal hashes of two pieces are as unlikely as in any 64-bit table.
    """

    def __init__(self, path: str, with_ids: bool, kept: int = KEPT_PIECES):
        self.tokenizer, self.with_ids, self.size = load(path), with_ids, kept
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.old, self.large, self.small = (self._run() for _ in range(3))
        self.mark, self.encoded = self._mark(), 0

    def _run(self, keys=(), lengths=(), ids=()) -> _Run:
        return _Run(np.array(keys, dtype=np.int64), np.array(lengths, dtype=np.int64), np.array(ids if self.with_ids else (), dtype=self.kind))

    def _mark(self) -> tuple[str, int] | None:
        """A line feed or a bar between spaces, if it is one token that no other text gives."""
        for text, joint in (("\n", "\n"), ("|", " | ")):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            if len(ids) == 1 and self.tokenizer.encode(joint.join("ab"), add_special_tokens=False).ids.count(ids[0]) == 1:
                return joint, ids[0]
        return None

    def known(self, lists: list[list[str]]) -> dict:
        """What all pieces of ``lists`` are: their ids as little-endian unsigned 32-bit numbers, or how many they have."""
        need = set().union(*lists)
        # A word with a stop is the word and the stop, so it needs no encoding of its own.
        stopped = {p for p in need if p[-1:] in {",", "."} and p[-2:-1] in LETTERS}
        pieces = list((need - stopped) | {p[:-1] for p in stopped} | {p[-1] for p in stopped})
        found: dict = {}
        for name in ("small", "large", "old"):
            keys, run = np.fromiter(map(hash, pieces), dtype=np.int64, count=len(pieces)), getattr(self, name)
            hit, at = run.find(keys)
            lengths, ids = run.take(at)
            found.update(zip(_where(pieces, hit), self._values(lengths, ids)))
            if name == "old" and len(lengths):
                self._keep(keys[hit], lengths, ids)
            pieces = _where(pieces, ~hit)
        if pieces:
            found.update(self._encode(pieces))
        found.update((p, found[p[:-1]] + found[p[-1]]) for p in stopped)
        return found

    def _values(self, lengths: np.ndarray, ids: np.ndarray) -> list:
        if not self.with_ids:
            return lengths.tolist()
        data, ends = ids.astype("<u4").tobytes(), np.cumsum(lengths) * 4
        return [data[a:b] for a, b in zip((ends - lengths * 4).tolist(), ends.tolist())]

    def _keep(self, keys: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        self.small = self.small.with_more(self._run(keys, lengths, ids))
        if len(self.small.keys) > max(len(self.large.keys) // 4, 1000):
            self.large, self.small = self.large.with_more(self.small), self._run()
        if len(self.large.keys) > self.size:
            self.old, self.large = self.large, self._run()

    def _encode(self, pieces: list[str]) -> dict:
        """Pieces in one text, with the mark between them, cut at its token again."""
        self.encoded += len(pieces)
        joint, mark = self.mark or ("", -1)
        bar = joint.strip(" ")
        joined = [p for p in pieces if p and bar not in p and p[-1] not in " " and not p.isspace()] if self.mark else []
        alone = list(set(pieces).difference(joined))
        order, parts, lengths = [], [], []
        for i in range(0, len(joined), TOGETHER):
            some = joined[i : i + TOGETHER]
            ids = np.array(self.tokenizer.encode(joint.join(some), add_special_tokens=False).ids, dtype=np.int64)
            cut = np.flatnonzero(ids == mark)
            if len(cut) != len(some) - 1:
                alone += some
                continue
            order += some
            lengths.append(np.diff(cut, prepend=-1, append=len(ids)) - 1)
            parts.append(ids[ids != mark])
        for p in alone:
            ids = self.tokenizer.encode(p, add_special_tokens=False).ids
            order.append(p)
            lengths.append(np.array([len(ids)], dtype=np.int64))
            parts.append(np.array(ids, dtype=np.int64))
        sizes, ids = np.concatenate(lengths), np.concatenate(parts)
        short = np.fromiter((len(p) <= KEPT_LENGTH for p in order), dtype=bool, count=len(order))
        keys = np.fromiter(map(hash, _where(order, short)), dtype=np.int64, count=int(short.sum()))
        self._keep(keys, sizes[short], ids[np.repeat(short, sizes)])
        return dict(zip(order, self._values(sizes, ids)))


def _where(pieces: list[str], mask: np.ndarray) -> list[str]:
    return list(compress(pieces, mask.tolist()))


def slabs(text: str):
    """Parts of about SLAB characters, cut before a space or line feed between two words."""
    at = 0
    while len(text) - at > SLAB:
        m = re.compile(f"(?<=[^{WHITE}])[ \n](?=[^{WHITE}])").search(text, at + SLAB)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def word_pieces(slab: str) -> list[str]:
    """Pieces of a text for a tokenizer of kind ``words``.

    It puts A-Z in lower case itself (but finds special strings before that) and drops white
    space, so both can be done here for fewer distinct pieces.
    """
    if "<|" not in slab:
        slab = slab.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    return slab.replace("\n", " ").split(" ")


class Counter:
    """Token counts of a list of texts."""

    def __init__(self, path: str):
        self.pieces, self.way, self.tokenizer, self.specials = Pieces(path, False), kind(path), load(path), _specials(path)

    def __call__(self, texts: list[str | None]) -> list[int]:
        counts, lists = [0] * len(texts), []
        for i, text in enumerate(texts):
            if not text:
                continue
            if self.way == "whole" or UNSURE.search(text):
                counts[i] = len(self.tokenizer.encode(text, add_special_tokens=False).ids)
                continue
            for slab in slabs(text):
                lists.append((i, byte_pieces(slab, self.specials) if self.way == "bytes" else word_pieces(slab)))
        known = self.pieces.known([p for _, p in lists])
        for i, parts in lists:
            counts[i] += sum(map(known.__getitem__, parts))
        return counts


class Coder:
    """Token ids of one text, as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        self.pieces = Pieces(path, True)
        self.way, self.tokenizer, self.specials = kind(path), load(path), _specials(path)

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        out, lists = [[] for _ in texts], []
        for i, text in enumerate(texts):
            if not text:
                continue
            if self.way == "whole" or UNSURE.search(text):
                out[i].append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes())
                continue
            for slab in slabs(text):
                lists.append((i, byte_pieces(slab, self.specials) if self.way == "bytes" else word_pieces(slab)))
        known = self.pieces.known([p for _, p in lists])
        for i, parts in lists:
            out[i].append(b"".join(map(known.__getitem__, parts)))
        return [b"".join(x) for x in out]


@lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    """One for each worker process, so that its later tasks find the pieces of earlier ones."""
    return Counter(path)


@lru_cache(maxsize=4)
def coder(path: str) -> Coder:
    return Coder(path)
