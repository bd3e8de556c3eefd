"""The plain functions behind the operators against direct computations."""

from __future__ import annotations

import heapq
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from subtide.llm import chat, mixing, packing, pii, simhash, suffix_dedup


def test_targets_stop_at_three_sizes_and_share_the_rest():
    found = mixing.targets([100, 100, 1000], [5, 2, 1])
    assert found == [300.0, 300.0, 600.0]
    assert mixing.targets([], []) == [] and mixing.targets([0, 10], [5, 1]) == [0.0, 10.0]


@pytest.mark.parametrize("seed", range(20))
def test_seats_go_to_the_highest_quotients(seed):
    rng = random.Random(seed)
    weights = [rng.choice([0, 1, 2, 5, 7, 100]) for _ in range(rng.randint(1, 9))]
    caps = [rng.choice([1, 5, 1000]) for _ in weights]
    seats = rng.randint(0, 40)
    given, heap = [0] * len(weights), [(-w, i) for i, w in enumerate(weights) if w]
    heapq.heapify(heap)
    for _ in range(seats):
        while heap and given[heap[0][1]] >= caps[heap[0][1]]:
            heapq.heappop(heap)
        if not heap:
            break
        i = heap[0][1]
        given[i] += 1
        heapq.heapreplace(heap, (-weights[i] / (2 * given[i] + 1), i))
    assert mixing.apportion(np.array(weights), seats, np.array(caps)).tolist() == given


def test_taken_runs_are_cut_out_of_the_text():
    text = "a  b\nc d"
    assert mixing.render(text, np.array([1, 2, 1]), np.array([2, 0, 1])) == ["a\nd", "a"]
    assert mixing.render(text, np.array([4]), np.array([2])) == [text, text]


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub(r"\D", "", m[0])
            doubled = [int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))]
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and (not 13 <= len(digits) <= 19 or sum(doubled) % 10):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            yield kind, *m.span()


def test_plain_spans_are_those_of_the_patterns():
    rng = random.Random(4)
    for _ in range(20_000):
        text = "".join(rng.choice("a1.@-+ 12(5é0") for _ in range(rng.randint(0, 45)))
        assert pii.detect(text) == list(plain_spans(text)), text


@pytest.mark.parametrize(
    "text, kind, span",
    [
        ("write to john dot doe (at) example [dot] com now", "email", "john dot doe (at) example [dot] com"),
        ("x anna at example dot com.", "email", "anna at example dot com"),
        ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
        ("a j​o@example.com", "email", "j​o@example.com"),
        ("call plus one two one two five five five zero one nine nine ok", "phone", "plus one two one two five five five zero one nine nine"),
        ("ip one nine two dot one six eight dot one dot one", "ip", "one nine two dot one six eight dot one dot one"),
        ("card four one one one one one one one one one one one one one one one", "card", "four" + " one" * 15),
        ("４１１１１１１１１１１１１１１１", "card", "４１１１１１１１１１１１１１１１"),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, span):
    _, more = pii.find(text)
    assert (kind, span) in [(k, text[a:b]) for k, a, b in more]
    assert pii.mask(text) == text.replace(span, f"<{kind.upper()}>")


@pytest.mark.parametrize(
    "text, kind, span",
    [
        ("call plus 1 415 555 0132 ok", "phone", "plus 1 415 555 0132"),
        ("ring +44 20 seven 946 0 nine 58 ok", "phone", "+44 20 seven 946 0 nine 58"),
        ("host 192.168.one.one ok", "ip", "192.168.one.one"),
        ("pay 4111 1111 1111 111 one ok", "card", "4111 1111 1111 111 one"),
        ("host 192.168.0.“FÜNF” or 192.168.0.FÜNF ok", "ip", "192.168.0.FÜNF"),
        ("host “192.168.0.one” ok", "ip", "192.168.0.one"),
        ("host 1O0.0.0.1 ok", "ip", "1O0.0.0.1"),
        ("host 2l1.0.0.1 ok", "ip", "2l1.0.0.1"),
        ("to anna at example.com ok", "email", "anna at example.com"),
        ("to anna @ example.com ok", "email", "anna @ example.com"),
        ("to anna@example{punto}com ok", "email", "anna@example{punto}com"),
        ("to anna@example dot com ok", "email", "anna@example dot com"),
    ],
)
def test_each_rewrite_alone_is_found(text, kind, span):
    _, more = pii.find(text)
    assert [(k, text[a:b]) for k, a, b in more] == [(kind, span)]


def test_the_gate_opens_for_all_that_is_rewritten(monkeypatch):
    rng = random.Random(8)
    pieces = [*pii.DIGITS, "plus", "PLUS", "at", "At", "arroba", "dot", "(at)", "[dot]", "{.", "}", "@", "ZÉRO", "fİve", "sıx", "a", "b.c", "+", "O", "l", "L", "i", "1", "55", "é", "_", "\u2003", "“", "”"]
    texts = ["".join(p + rng.choice(["", " ", " ", "  ", ".", "-", "\n"]) for p in rng.choices(pieces, k=rng.randint(1, 5))) for _ in range(20_000)]
    gated = [(n.text, n.changed) for n in map(pii.normalise, texts)]
    monkeypatch.setattr(pii, "_disguised", lambda text: True)
    assert gated == [(n.text, n.changed) for n in map(pii.normalise, texts)]


def test_clean_texts_have_no_spans():
    for text in ("Look at home. Then dot the i.", "one two three four", "room 12, at 5 o'clock", "un deux trois", ""):
        assert pii.find(text) == ([], []) and pii.mask(text) == text


def test_conversations_read_back_whatever_they_hold():
    rng, encode = random.Random(3), chat.tokenizer().encode
    pieces = ["<", "|", "\\", "s>", "/", "[", "INST]", "<|end|>", "<|turn|>", "ok", " ", "é", "😀", "\n", "</s>", "<<SYS>>", "<|endoftext|>"]
    for _ in range(500):
        turns = [(rng.choice(["user", "assistant", "system", ""]), "".join(rng.choices(pieces, k=rng.randint(0, 9)))) for _ in range(rng.randint(0, 5))]
        text, spans = chat.render(turns)
        offsets = np.array(encode(text, add_special_tokens=False).offsets, np.int32).reshape(-1, 2)
        mask = chat.loss_mask(offsets, np.array(spans, np.int32).reshape(-1, 2))
        assert chat.parse(text) == turns
        assert chat.masked_texts(text, offsets[:, 0], offsets[:, 1], mask) == "".join(t for r, t in turns if r == "assistant")


def test_every_pair_within_the_radius_meets_under_a_mask():
    rng = random.Random(1)
    for radius in (1, 2, 3):
        masks = simhash.masks(radius)
        assert len(masks) == 2 ** (radius + 1) - 1
        for _ in range(2000):
            difference = sum(1 << b for b in rng.sample(range(64), radius))
            assert any(not difference & m for m in masks)


def test_patterns_hold_every_piece_once_and_fit():
    rng = random.Random(2)
    for n in (0, 1, 30, 3000):
        lengths = Counter(rng.randint(1, 2048) for _ in range(n))
        packs = packing.pack_histogram(lengths)
        used = Counter()
        for pattern, count in packs.items():
            assert sum(pattern) <= 2048
            for length in pattern:
                used[length] += count
        assert used == lengths
        if n == 3000:
            assert sum(len_ * c for len_, c in lengths.items()) > 0.97 * 2048 * sum(packs.values())


def test_ids_are_those_of_tokenizers():
    import public_tokenizers

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["", "a b", "  two\n\n\tlines ", "Éaux çà 😀 x​y", "<|endoftext|> in", "don't 1234 %%%", "\x00\x7f", "٣٤ x²"]
    assert packing.encoder()(texts) == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_transform_is_that_of_sorted_suffixes():
    strings = [b"banana" * 9, b"ananas" * 9, b"banana" * 9]
    found = suffix_dedup.transform(strings)
    symbol = lambda s, i: (s[i] + 1) * suffix_dedup.BASE + (s[i + 1] + 1 if i + 1 < len(s) else 0) if i < len(s) else 0
    rows = [(tuple(symbol(s, j) for j in range(i, len(s), 2)), n, i) for n, s in enumerate(strings) for i in range(len(s) + 2)]
    assert found.tolist() == [symbol(strings[n], i - 2) if i >= 2 else 0 for _, n, i in sorted(rows)]


@pytest.mark.parametrize("shard", [1, 2, 100])
def test_merged_intervals_are_equal_windows(shard, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SHARD", shard)
    rng = random.Random(shard)
    parts = [bytes(rng.choice(b"ab") for _ in range(25)) for _ in range(4)]
    strings = sorted({b"".join(rng.choices(parts, k=3)) for _ in range(30)}, key=lambda _: rng.random())
    docs = np.array([rng.randint(0, 9) for _ in strings])
    least = {}
    for s, d in zip(strings, docs):
        for i in range(len(s) - 49):
            least[s[i : i + 50]] = min(least.get(s[i : i + 50], 99), d)
    string, place, doc = suffix_dedup.least_documents(strings, docs)
    assert {(int(s), int(i)): int(d) for s, i, d in zip(string, place, doc)} == {(n, i): least[s[i : i + 50]] for n, s in enumerate(strings) for i in range(len(s) - 49)}


def test_fingerprint_follows_its_definition():
    from xxhash import xxh64_intdigest

    def direct(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    for text in (None, "", "One", "one two", "A b C", "É é x y z É", "a b c " * 50, "p q r\x1fs t u\vv w"):
        assert simhash.fingerprint(text) == direct(text), text


def test_long_runs_take_linear_time():
    for text in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "@" * 200_000, "+1" * 100_000, "one " * 50_000, " " * 100_000 + "at", "(" * 100_000):
        pii.find(text)
    assert math.isfinite(len(text))
