import random

import pytest

WORDS = "the of and to in on for that edre thion enble über straße él niño ça naïve x1 42 it's can't".split()


@pytest.fixture(scope="session")
def odd_texts():
    """Nulls, blanks, odd characters, ties, a long text and repeated texts."""
    r = random.Random(5)
    long = " ".join(r.choice(WORDS) for _ in range(20000))
    return [
        None, "", " ", "\n\n\t", "a", "A", "word", "  two  spaces ", "tab\tnew\nline\r\nend", "'s 'll don't", "漢字かな交じり文", "é combining", "😀 emoji😀😀",
        "x" * 5000, "a b " * 3000, long, long, long + " tail", "<|endoftext|> <|ENDOFTEXT|>", "\x00nul\x1cfs\x85nel", "ÀÉÎ ŸŒ ǅ İstanbul ΣΑΣ", "1234567 3.14 a1b2",
    ]
