"""Phrase mining and personal data against plain Python."""

import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import pytest

from recallspark.llm import phrases, pii
from tests.llm.rows import frame, odd_texts


def plain(rows, least, top):
    """rows of (lang, text); all n-grams counted in a dictionary."""
    count, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]+", lambda m: m.group().lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, 5):
                count.update((lang, tuple(words[i:i + k])) for i in range(len(words) - k + 1))
    often = {p: f for p, f in count.items() if f >= least}
    candidates = {p: f for p, f in often.items() if len(p[1]) > 1}
    dropped = set()
    for (lang, w), f in candidates.items():
        for k in range(2, len(w)):
            dropped |= {(lang, w[i:i + k]) for i in range(len(w) - k + 1) if 100 * f >= 80 * candidates[lang, w[i:i + k]]}
    scored = []
    for (lang, w), a in candidates.items():
        if (lang, w) not in dropped:
            score, k = min((2000000 * a // (often[lang, w[:k]] + often[lang, w[k:]]), k) for k in range(1, len(w)))
            scored.append((lang, " ".join(w), a, often[lang, w[:k]], often[lang, w[k:]], total[lang], score))
    scored.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    out, rank = [], Counter()
    for lang, phrase, a, left, right, n, score in scored:
        rank[lang] += 1
        if rank[lang] <= top:
            out.append((lang, rank[lang], phrase, a, left, right, n, score))
    return out


def prose(n, seed):
    rng = random.Random(seed)
    vocabulary = ["the", "New", "york", "new", "of", "city", "ä", "汉字", "a-b", "x\x1cy", "z z"]
    fixed = ["in the city of new york", "as far as I know", "汉字 ä of the"]
    out = []
    for _ in range(n):
        words = []
        for _ in range(rng.randint(0, 25)):
            words.append(rng.choice(fixed) if rng.random() < 0.2 else rng.choice(vocabulary))
            words.append(rng.choice([" ", "  ", "\t", " ", " ", ", ", ".", "\n", "\r\n", "!? "]))
        out.append((rng.choice(["en", "en", "en", None, "und", "de"]), "".join(words)))
    return out


@pytest.mark.parametrize("shard_words,least", [(1 << 20, 30), (200, 5), (1, 30)])
def test_phrases(spark, shard_words, least):
    """One shard a language, many shards, one shard a piece."""
    rows = prose(400 if shard_words > 1 else 150, 7) + [("en", t) for _, t in odd_texts()] + [("fr", None), ("it", "only " * 40)]
    df = spark.createDataFrame([(lang, t, "w", 1, "i") for lang, t in rows], "lang string, text string, words string, shard int, phrase string")
    got = phrases.mine_phrases(df.repartition(3), least=least, top=40, shard_words=shard_words)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = plain(rows, least, 40)
    assert len(want) > 10
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_index():
    """Intervals and sizes of every extension, against the text itself."""
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 6, 500).astype(np.int32)
    index = phrases.Index(ids, 4)
    start, reverse, size = index.single()
    grams = [(w,) for w in range(1, 6)]
    for k in (2, 3, 4):
        phrase, word, start, reverse, size = index.longer(start, reverse, size)
        grams = [(int(c), *grams[p]) for c, p in zip(word, phrase)]
        seen = Counter(tuple(ids[i:i + k].tolist()) for i in range(len(ids) - k + 1))
        assert dict(zip(grams, size.tolist())) == {g: n for g, n in seen.items() if 0 not in g}


def test_no_phrases(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert phrases.mine_phrases(empty).collect() == []
    assert phrases.mine_phrases(frame(spark, odd_texts())).where("a < 30").collect() == []


def base(text):
    """The four expressions as they are written."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in re.sub("[^0-9]", "", m.group())][::-1]
        if 16 <= len(d) <= 19 and sum(sum(divmod(c * (1 + i % 2), 10)) for i, c in enumerate(d)) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return out


DISGUISED = [
    ("email", "john [dot] doe [at] example [dot] com"), ("email", "jane at example dot com"), ("email", "me(at)example.org"), ("email", "аdmin@ехample.com"),
    ("email", "juan arroba correo punto es"), ("email", "a​b@c⁠d.de"), ("email", "u1@mail (dot) example {.} net"), ("email", "ｊｏｅ＠ｅｘ.com"),
    ("ip", "127 [.] 0 [.] 0 [.] 1"), ("ip", "one nine two dot one six eight dot zero dot one"), ("ip", "10 dot 0 dot 0 dot 7"), ("ip", "１９２.168.0.1"),
    ("card", "four one one one one one one one one one one one one one one one"), ("card", "４１１１ 1111 1111 1111"), ("card", "4111 1111‑1111 1111"),
    ("phone", "+1 five five five one two three four five"), ("phone", "plus four nine one seven zero one two three four"), ("phone", "＋49 (170) 555‑0199"),
]
PROSE = ["Look at this point in time, we met at the house at noon. ", "Plus 3 of them came at 5 o'clock; the dot matrix printed. ", "Six un deux, neuf sept. ",
         "L'été à Paris – déjà vu · plus tard. ", "Price: 12.50, at 3.14.15 it ended. "]


def test_plain_identifiers():
    rng = random.Random(1)
    for _ in range(20000):
        text = "".join(rng.choices("a1230.@-+() é45", k=rng.randint(0, 60)))
        found = pii.spans(text)
        assert found[0] == base(text)
        assert set(found[0]) <= set(found[1])


def test_disguised_identifiers():
    """Each one in prose of any kind, at its place in the source; prose alone holds nothing."""
    rng = random.Random(2)
    for prose_text in PROSE:
        assert pii.spans(prose_text * 3) == ([], [])
    for _ in range(300):
        text, want = "", []
        for _ in range(rng.randint(1, 4)):
            text += rng.choice(PROSE) + rng.choice(["​", "", "é "]) + "Write: "
            kind, own = rng.choice(DISGUISED)
            want.append((kind, len(text), len(text) + len(own)))
            text += own + ", "
        found = pii.spans(text)[1]
        assert set(want) <= set(found), (text, want, found)
        for kind, a, b in found:  # what else is found is a plain part of a planted one
            assert any(k == kind and x <= a and b <= y for k, x, y in want)


def test_long_texts_take_linear_time():
    for unit in (" ", "1", "a", "1.", "a.", "+1 ", "at ", "[", "@", "one ", "a@", " dot "):
        started = time.time()
        pii.spans(unit * (300_000 // len(unit)))
        assert time.time() - started < 20, unit


def test_table(spark):
    texts = odd_texts() + [(50 + i, own) for i, (_, own) in enumerate(DISGUISED)] + [(80, "a@b.cd, 1.2.3.4 and +1 (017) 555-7713, 4111 1111 1111 1111")]
    got = pii.find_pii(frame(spark, texts)).collect()
    assert len(got) == len(texts)
    want = {}
    for i, t in texts:
        own = base(t or "")
        sha = hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in own).encode()).hexdigest()
        want[i, t] = (*(sum(k == kind for k, _, _ in own) for kind in pii.KINDS), sha)
    assert sorted([(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got], key=str) == sorted(
        [(i, *want[i, t]) for i, t in texts], key=str)
    by_id = {r.doc_id: r.spans for r in got}
    assert all(f"{kind}:0:{len(own)}" in by_id[50 + i].split(",") for i, (kind, own) in enumerate(DISGUISED))
    assert pii.find_pii(frame(spark, [])).collect() == []
    masked = {r.doc_id: r.text for r in pii.redact(frame(spark, texts)).collect()}
    assert masked[80] == "<email>, <ip> and <phone>, <card>" and masked[1] is None and masked[51] == "<email>"
