"""Token counts by the whole-token shortcut.

Before any text is read, every vocabulary string is run through the merges of the model on
its own; those that come out as one token form the shortcut table.  A text is cut into
pre-tokens by the model's pattern.  A pre-token in the table counts one at once, only the
rest goes through the merges.  The table and the merge lists have the vocabulary's size
and are sent to the executors once; nothing is shuffled.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import query, read

# fixed values: the pre-token pattern of byte-level vocabularies, with the white space of the library spelled out
SPACE = r"\t\n\x0b\x0c\r \x85\xa0  -     　"
PRE_TOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"

#: Largest vocabulary file that is sent to the executors.
FILE_BOUND = 64 << 20
#: Merged pre-tokens that a Python worker remembers before it starts anew.
MEMO = 1_000_000
_counts: dict[int, Counts] = {}


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: printable ones for themselves, the others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def load(path: str) -> str:
    """The vocabulary file as text, checked to be a plain byte-level BPE of a bounded size."""
    with open(path, encoding="utf-8") as f:
        body = f.read(FILE_BOUND + 1)
    if len(body) > FILE_BOUND:
        raise ValueError(f"{path} is larger than {FILE_BOUND} bytes")
    spec = json.loads(body)
    pre = spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or pre.get("type") != "ByteLevel" or not pre.get("use_regex") or pre.get("add_prefix_space") or spec["model"].get("type") not in ("BPE", None):
        raise ValueError(f"{path} is not a plain byte-level BPE")
    return body


def whole_tokens(body: str) -> list[str]:
    """Vocabulary strings (as text) that the merges alone turn into exactly one token."""
    from tokenizers import Tokenizer

    model, byte_of = Tokenizer.from_str(body).model, {c: b for b, c in byte_letters().items()}
    out = []
    for piece in json.loads(body)["model"]["vocab"]:
        try:
            text = bytes(byte_of[c] for c in piece).decode()
        except (KeyError, UnicodeDecodeError):
            continue  # part of a character: no pre-token
        if len(model.tokenize(piece)) == 1:
            out.append(text)
    return out


def disputed(body: str) -> str:
    """Letters and digits of the pattern's engine that the library's older tables do not know as such, as the ranges of a character class."""
    import regex
    from tokenizers import Tokenizer

    every = "".join(map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x110000))))
    pre, odd = Tokenizer.from_str(body).pre_tokenizer, []
    for kind, lead in ((r"\p{L}", "a"), (r"\p{N}", "1")):
        found = regex.findall(kind, every)
        mapped = pre.pre_tokenize_str("".join(f"\n{lead}{c}" for c in found))
        ends = {e for _, (_, e) in mapped}
        odd += [ord(c) for i, c in enumerate(found) if 3 * i + 2 in ends]
    odd.sort()
    first = [c for i, c in enumerate(odd) if not i or odd[i - 1] != c - 1]
    last = [c for i, c in enumerate(odd) if i + 1 == len(odd) or odd[i + 1] != c + 1]
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(first, last, strict=True))


def latin(text: str) -> bool:
    """Whether all characters are below U+0100, where no letter is disputed."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Counts(dict):
    """Tokens of a pre-token: one for the proven strings, merged and remembered for the rest."""

    def __init__(self, body: str, whole: list[str]):
        from tokenizers import Tokenizer

        super().__init__(dict.fromkeys(whole, 1))
        self.library = Tokenizer.from_str(body)
        self.model, self.letter, self.whole = self.library.model, byte_letters(), whole
        self.left = MEMO

    def __missing__(self, word: str) -> int:
        n = len(self.model.tokenize("".join(self.letter[b] for b in word.encode())))
        self.left -= 1
        if self.left < 0:
            self.clear()
            self.update(dict.fromkeys(self.whole, 1))
            self.left = MEMO
        self[word] = n
        return n


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row.

    Special tokens inside a text count one each, as the library finds them by default.  A
    text with characters newer than the library's tables goes through the library whole.  A null text counts as empty.  Row by row: repeated ids and texts give repeated rows, an
    empty table gives none, other columns are not read.
    """
    body = load(path)
    ctx = docs.sparkSession.sparkContext
    sent = ctx.broadcast((body, whole_tokens(body), disputed(body)))
    special = [t["content"] for t in json.loads(body).get("added_tokens", [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        body, whole, odd = sent.value
        if (key := hash(body)) not in _counts:
            _counts.clear()
            _counts[key] = Counts(body, whole)
        counts = _counts[key]
        words = regex.compile(PRE_TOKEN).findall
        unsure = re.compile(f"[{odd}]").search if odd else lambda t: None
        cut = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        get = counts.__getitem__
        for b in batches:
            n_bytes, n_tokens = [], []
            for t in b.column(1):
                t = t.as_py() or ""
                n_bytes.append(len(t.encode()))
                if not latin(t) and unsure(t):
                    n_tokens.append(len(counts.library.encode(t, add_special_tokens=False).ids))
                elif cut is not None and any(s in t for s in special):
                    parts = cut.split(t)
                    n_tokens.append(len(parts) - 1 + sum(sum(map(get, words(p))) for p in parts))
                else:
                    n_tokens.append(sum(map(get, words(t))))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


@query("op6_token_counts")
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 1024)
