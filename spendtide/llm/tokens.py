"""Python-side work on texts inside tasks: words, their codes, and hashes of word sequences."""

import numpy as np
import xxhash

U64 = np.uint64
#: Words whose codes a task remembers; beyond it starts afresh, so memory is bounded.
KNOWN_WORDS = 300_000


class WordCodes(dict):
    """Word (bytes) -> 64-bit code, remembered."""

    def __missing__(self, word: bytes) -> int:
        code = self[word] = xxhash.xxh3_64_intdigest(word)
        return code


def code_words(words: list[bytes], known: WordCodes) -> np.ndarray:
    if len(known) > KNOWN_WORDS:
        known.clear()
    return np.fromiter(map(known.__getitem__, words), U64, len(words))


def split_words(text: str | None) -> list[bytes]:
    """Runs of bytes other than space and 0x09-0x0D: what `bytes.split` parts at."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def lowered_words(text: str | None) -> list[bytes]:
    """The same with A-Z in lower case; bytes.lower() touches no other letter."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


# ASCII letters and digits, and all bytes of other code points, make words; A-Z count as a-z.
_ALNUM = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def alnum_words(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and code points from U+0080 on, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_ALNUM).split()
