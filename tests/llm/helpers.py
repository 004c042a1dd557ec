"""Small tables with the awkward cases, and plain versions of what the operators compute."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def made_text(rng: random.Random, n: int, words: str = "the of and thin onent erly stoun wha ti blere ounds") -> str:
    return " ".join(rng.choice(words.split()) + rng.choice(("", "", "", ",", ".")) for _ in range(n))


def awkward_rows() -> list[tuple]:
    """Nulls in any column, empty, blank and long texts, copies, ties, repeated rows and repeated ids."""
    rng = random.Random(1)
    base = [made_text(rng, rng.randint(1, 60)) for _ in range(30)]
    rows = [(k, t, "en", f"s{k % 3}", len(t)) for k, t in enumerate(base)]
    rows += [(100, None, "en", "s", None), (101, "", None, None, 0), (102, " \n\t ", "en", "s", 4), (103, "123 !!", "en", "s", 6), (None, base[0], "en", "s", 1), (None, None, None, None, None)]
    rows += [(104 + k, base[1], "en", "s", 1) for k in range(20)] + [(5, base[5], "en", "s2", len(base[5]))] * 2
    rows += [(130, made_text(rng, 9000), "en", "s", 1), (131, "a  b c\r\nd", "en", "s", 1), (132, "ÀÉ Straße 日本 語\n日本 語\n日本 語", "de", "s", 1), (133, "<|endoftext|> x", "en", "s", 1)]
    return rows


def near_copies() -> list[tuple]:
    rng = random.Random(2)
    long = [made_text(rng, 300, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi") for _ in range(6)]
    rows = [(1000 + 10 * k + j, t if j == 0 else t.replace("alpha", "alphas", j), "en", "s", 1) for k, t in enumerate(long) for j in range(4)]
    return rows


def words13(text: str | None) -> list[str]:
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)
