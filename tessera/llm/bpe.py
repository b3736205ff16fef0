"""Byte-pair encoding and decoding with a public vocabulary.

The work is done on the distinct words of a batch: a word is normalised and turned into symbols once, all words of the
batch lie end to end in one flat symbol array, and each round merges, in every word, the pair of the lowest rank. Ranks are
found by binary search over the sorted pair keys. Texts are then put together from their words' tokens.

Null and empty texts have no tokens; a text of any length is treated alike, since only its distinct words are merged. Rows
are independent, so repeated rows give repeated results. Input columns stay; a column whose name an operator adds is replaced.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.text import slices

# Where the tokenizers library knows an older Unicode than Python and regex do. Code points, in hexadecimal, that
# are no letters to it, no numbers, and marks that neither move nor compose; and capitals that only it lowers.
_NOT_LETTERS = (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DF1 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 "
    "187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 "
    "1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
_NOT_NUMBERS = "11DE0-11DE9 1246F 12475-1247F 12550-12686 16FF4-16FF6"
_FIRM_MARKS = (
    "7FD 898-89F 8CA-8D3 9FE C3C D3B-D3C EBA 1715 1ABF-1ACE 1DF6-1DFA A82C 10D24-10D27 10EAB-10EAC 10EFD-10EFF 10F46-10F50 10F82-10F85 11070 1133B 1145E 11839-1183A 11930 1193D-1193E 11943 119E0 11A34 11A47 11A99 "
    "11D42 11D44-11D45 11D97 11F41-11F42 16FF0-16FF1 1E08F 1E130-1E136 1E2AE 1E2EC-1E2EF 1E4EC-1E4EF"
)
_LOWERED = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
_LOWERED |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}


def _set_of(ranges: str) -> str:
    """Ranges of code points in hexadecimal as a set of a regular expression."""
    return "[" + "".join("-".join(chr(int(c, 16)) for c in r.split("-")) for r in ranges.split()) + "]"


_LETTER, _NUMBER = rf"[\p{{L}}--{_set_of(_NOT_LETTERS)}]", rf"[\p{{N}}--{_set_of(_NOT_NUMBERS)}]"
_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+", regex.V0)
# The same for texts with characters that only regex takes for letters or numbers; sets cut out of sets make it slower.
_RARE_WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|{_LETTER}+|{_NUMBER}|[^\s{_LETTER}{_NUMBER}]+", regex.V1)
_RARE = regex.compile(_set_of(f"{_NOT_LETTERS} {_NOT_NUMBERS}"))
_FIRM = regex.compile(f"({_set_of(_FIRM_MARKS)})")
_ANY_OF_THESE = re.compile("[\u0558-\U0010ffff]")  # all code points above are in this range, most texts have none of it
_WORD_END = "</w>"


def _byte_letters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


@dataclass(frozen=True)
class Vocabulary:
    tokens: list[str]
    first: np.ndarray  # byte -> symbol inside a word
    last: np.ndarray  # byte -> symbol that ends a word
    keys: np.ndarray  # left symbol << 32 | right symbol, sorted
    ranks: np.ndarray
    merged: np.ndarray
    special: dict[str, int]


@lru_cache(maxsize=4)
def load(path: str) -> Vocabulary:
    """Read a vocabulary file in the JSON form of the tokenizers library (kind BPE with word ends)."""
    with open(path, encoding="utf-8") as f:
        raw = json.load(f)
    vocab, merges = raw["model"]["vocab"], raw["model"]["merges"]
    special = {t["content"]: t["id"] for t in raw["added_tokens"]}
    tokens = [""] * (max(max(vocab.values()), *special.values()) + 1)
    for t, i in (*vocab.items(), *special.items()):
        tokens[i] = t
    pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in merges]
    left = np.array([vocab[a] for a, _ in pairs], np.int64)
    right = np.array([vocab[b] for _, b in pairs], np.int64)
    merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
    keys = left << 32 | right
    # A pair listed twice keeps its later rank, as in a table filled line by line.
    order = np.argsort(keys, kind="stable")
    final = np.append(keys[order][1:] != keys[order][:-1], True) if len(keys) else np.zeros(0, bool)
    order = order[final]
    letters = _byte_letters()
    return Vocabulary(
        tokens,
        np.array([vocab[c] for c in letters], np.int32),
        np.array([vocab[c + _WORD_END] for c in letters], np.int32),
        keys[order],
        order.astype(np.int32),
        merged[order],
        special,
    )


def merge_words(words: list[str], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all words end to end, and the offset of each word's first token."""
    raw = [w.encode() for w in words]
    sizes = np.array([len(b) for b in raw], np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    symbols = v.first[data]
    word = np.repeat(np.arange(len(words)), sizes)
    ends = np.cumsum(sizes) - 1
    symbols[ends] = v.last[data[ends]]
    done_symbols, done_words, done_at = [], [], []
    at = np.arange(len(symbols))  # first byte of each symbol: keeps the order when results are put together
    none = np.iinfo(np.int32).max
    while len(symbols):
        keys = symbols[:-1].astype(np.int64) << 32 | symbols[1:]
        place = np.minimum(np.searchsorted(v.keys, keys), len(v.keys) - 1)
        rank = np.where((v.keys[place] == keys) & (word[:-1] == word[1:]), v.ranks[place], none)
        rank = np.append(rank, none)
        begins = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        lowest = np.minimum.reduceat(rank, begins)
        spans = np.diff(np.append(begins, len(symbols)))
        # Words without a mergeable pair are ready and leave the array.
        live = np.repeat(lowest != none, spans)
        if not live.all():
            done_symbols.append(symbols[~live]), done_words.append(word[~live]), done_at.append(at[~live])
            symbols, word, at, rank, place = symbols[live], word[live], at[live], rank[live], np.append(place, 0)[live]
            if not len(symbols):
                break
            spans, lowest = spans[lowest != none], lowest[lowest != none]
        else:
            place = np.append(place, 0)
        hit = rank == np.repeat(lowest, spans)
        # In a run such as "aaa" the pairs overlap: from the left, every second one is merged.
        runs = np.flatnonzero(hit & ~np.append(False, hit[:-1]))
        index = np.arange(len(hit))
        start_of_run = np.zeros(len(hit), np.int64)
        start_of_run[runs] = runs
        start_of_run = np.maximum.accumulate(start_of_run)
        hit &= (index - start_of_run) % 2 == 0
        left = np.flatnonzero(hit)
        symbols[left] = v.merged[place[left]]
        keep = np.ones(len(symbols), bool)
        keep[left + 1] = False
        symbols, word, at = symbols[keep], word[keep], at[keep]
    if not done_symbols:
        return np.zeros(0, np.int32), np.zeros(len(words) + 1, np.int64)
    symbols, word, at = np.concatenate(done_symbols), np.concatenate(done_words), np.concatenate(done_at)
    order = np.argsort(at)
    return symbols[order], np.searchsorted(word[order], np.arange(len(words) + 1))


def normalize(text: str, plain: bool = False) -> str:
    """NFC and small letters, as the tokenizers library gives them; ``plain`` texts have no code point that it sees otherwise."""
    if text.isascii():
        return text.lower()
    if plain or not _FIRM.search(text):
        text = unicodedata.normalize("NFC", text)
    else:
        text = "".join([unicodedata.normalize("NFC", part) for part in _FIRM.split(text)])
    if not plain:
        text = text.translate(_LOWERED)
    # Letters are lowered one by one, so a capital sigma at a word's end becomes the ordinary small one.
    return text.replace("Σ", "σ").lower()


def words_of(text: str) -> list[str]:
    if text.isascii() or not _ANY_OF_THESE.search(text):
        return _WORD.findall(normalize(text, plain=True))
    text = normalize(text)
    return (_RARE_WORD if _RARE.search(text) else _WORD).findall(text)


class Encoder:
    """Encodes texts batch by batch; what it knows of words is dropped when it grows past ``most_words``."""

    def __init__(self, path: str, most_words: int = 150_000):
        self.v, self.most = load(path), most_words
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.v.special)) + ")") if self.v.special else None
        self.known: dict[str, tuple[str, str, int]] = {}

    def split(self, text: str) -> list[str]:
        if self.specials is None or "<|" not in text:
            return words_of(text)
        out = []
        for k, part in enumerate(self.specials.split(text)):
            if k % 2:
                out.append("\0" + part)  # no word begins with a null character and goes on with a bar
            elif part:
                out += words_of(part)
        return out

    def learn(self, words: set[str]) -> None:
        if len(self.known) + len(words) > self.most:
            self.known.clear()
        fresh = [w for w in words if w not in self.known]
        marked = [w for w in fresh if w[0] == "\0" and w[1:] in self.v.special]
        plain = [w for w in fresh if not (w[0] == "\0" and w[1:] in self.v.special)]
        ids, offsets = merge_words(plain, self.v) if plain else (np.zeros(0, np.int32), np.zeros(1, np.int64))
        ids, offsets, tokens = ids.tolist(), offsets.tolist(), self.v.tokens
        for k, w in enumerate(plain):
            own = ids[offsets[k] : offsets[k + 1]]
            self.known[w] = " ".join(map(str, own)), " ".join([tokens[i] for i in own]), len(own)
        for w in marked:
            self.known[w] = str(self.v.special[w[1:]]), w[1:], 1

    def encode(self, texts: list[str | None]) -> Iterator[tuple[str, str, int]]:
        """Ids joined by spaces, decoded text, number of tokens."""
        split = [self.split(t) if t else [] for t in texts]
        self.learn({w for ws in split for w in ws})
        known = self.known
        for ws in split:
            found = [known[w] for w in ws]
            yield " ".join([f[0] for f in found]), " ".join([f[1] for f in found]), sum([f[2] for f in found])


def decode(ids: list[int], path: str) -> str:
    """Tokens joined by single spaces: the vocabulary has no decoder that would join words."""
    v = load(path)
    return " ".join([v.tokens[i] for i in ids if 0 <= i < len(v.tokens)])


def bpe(docs: DataFrame, path: str, digests: bool = True, ids: bool = False, text_column: str = "text") -> DataFrame:
    """Encode ``text_column`` and decode it again, in place of a shuffle within each input partition.

    Adds ``n_tokens``; with ``digests`` ``ids_sha256`` (of the decimal ids joined by one space) and ``decoded_sha256``; with
    ``ids`` the arrays ``token_ids`` and ``decoded``.
    """
    added = ["n_tokens long"] + ["ids_sha256 string", "decoded_sha256 string"] * digests + ["token_ids array<int>", "decoded string"] * ids
    names = {a.split()[0] for a in added}
    kept = [c for c in docs.columns if c not in names and (c != text_column or ids)]
    source = docs.select(*dict.fromkeys([*kept, text_column]))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept] + added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for whole in batches:
            for batch in slices(whole, text_column, 1 << 20):
                counts, a, b, arrays, texts = [], [], [], [], []
                for id_text, decoded, n in encoder.encode(batch.column(text_column).to_pylist()):
                    counts.append(n)
                    if digests:
                        a.append(hashlib.sha256(id_text.encode()).hexdigest())
                        b.append(hashlib.sha256(decoded.encode()).hexdigest())
                    if ids:
                        arrays.append(np.array(id_text.split(), np.int32) if id_text else np.zeros(0, np.int32))
                        texts.append(decoded)
                columns = [batch.column(c) for c in kept] + [pa.array(counts, pa.int64())]
                if digests:
                    columns += [pa.array(a, pa.string()), pa.array(b, pa.string())]
                if ids:
                    columns += [pa.array(arrays, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [*kept, *(x.split()[0] for x in added)])

    return source.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``: ids and decoded text as digests."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return bpe(docs, public_tokenizers.path("word_bpe_49k.json"))
