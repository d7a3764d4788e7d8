"""run() over a small table with planted cases, against plain versions of its five stages."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
from test_language import brute_counts, packed
from test_quality import brute as measures
from test_secret import ASSIGN, brute_ratio
from tokenizers import Tokenizer

import corpus_pipeline
from cohortweave.llm import language_id as li
from cohortweave.llm import packing
from cohortweave.llm import probminhash as pm
from cohortweave.llm import secret_scan as ss

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def planted():
    """(rows, ids of clean rows that must stay, ids that must go)."""
    draw = random.Random(17)
    rows = [tuple(r.values()) for r in pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=list(COLUMNS)).to_pylist()]
    english = sorted({w for _, t, lang, *_ in rows if t and lang == "en" for w in re.findall("[a-z]{2,}", t)})
    stay, go = [], []

    def prose(n):
        # numbers keep the five-word runs of different texts apart
        return " ".join(f"{draw.choice(english)}{'' if draw.random() < 0.7 else draw.randrange(10**6)}" for _ in range(n))

    def add(doc_id, text, kept=None):
        rows.append((doc_id, text, "en" if doc_id and doc_id % 2 else None, "planted", None if text is None else len(text)))
        if kept is not None:
            (stay if kept else go).append(doc_id)

    at = 10**6
    for family in range(6):  # exact, spaced and near copies: the least id stays
        base = prose(160).split()
        add(at, " ".join(base), True)
        for copy in range(1, 5):
            words = list(base)
            if copy > 2:
                words[draw.randrange(len(words))] = "changed"
            add(at + copy, ("  " if copy == 2 else " ").join(words), False)
        at += 10
    # the chain's ends are unlike each other, but are linked by what lies between
    chain = prose(100).split()
    for step in range(8):
        chain = chain[: 3 * step] + prose(3).split() + chain[3 * step + 3 :]
        add(at + step, " ".join(chain), step == 0)
    at += 10
    clean = prose(80)
    for text in (None, "", " \n\t", "1234 5678 " * 60, "too short to stay", prose(20) + " and again and again" * 60,
                 " ".join(f"{w} # $" for w in clean.split()), clean.upper(), "\n".join([clean[:60]] * 30 + [prose(200)]),
                 " ".join(chr(0x4E00 + i) + chr(0x5E00 + i) for i in range(90))):
        add(at, text, False)
        at += 1
    token = "Zx8Kq2LmP0vB7nQwR31LsT9yAbC4"
    for secret in (f'password = "{token}"', f"AKIA{'Q7'*9}", "deadbeef01" * 3, f"secret: {token} é😀 token={token[::-1]}", token):
        add(at, f"{prose(60)} {secret} {prose(30)}\n{secret}", True)
        at += 1
    add(at, "\n".join(prose(15) for _ in range(1500)), True)  # a very long text
    add(at + 1, prose(400) + " <|endoftext|> " + prose(20), True)
    shared = prose(60)  # a passage that different texts share
    add(at + 2, f"{shared} {prose(200)}", True)
    add(at + 3, f"{prose(250)} {shared}", True)
    add(at + 4, prose(90))  # an id that stands for two texts, and one row twice
    add(at + 4, prose(90))
    add(at + 5, prose(70), True)
    rows.append(rows[-1])
    nameless = prose(75)
    add(None, nameless)
    add(None, nameless)
    add(None, prose(75))
    draw.shuffle(rows)
    return rows, stay, go


def known_languages(rows):
    counts = defaultdict(Counter)
    for doc_id, text, lang, *_ in rows:
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 and lang is not None and text is not None:
            counts[lang].update(brute_counts(text))

    def ordered(grams, places):
        return [g for _, _, g in sorted((-n, packed(g), g) for g, n in grams.items())][:places]

    profiles = {lang: {g: i for i, g in enumerate(ordered(c, li.PROFILE_PLACES))} for lang, c in counts.items()}

    def known(text):
        own = ordered(brute_counts(text or ""), li.DOCUMENT_PLACES)
        most = li.PROFILE_PLACES
        away = [sum(abs(p[g] - i) if g in p else most for i, g in enumerate(own)) for p in profiles.values()]
        return bool(own) and 1 - min(away) / (most * len(own)) >= li.LEAST_SCORE

    return [r for r in rows if known(r[1])]


def good(row):
    text = row[1] or ""
    n_words, word_chars, n_symbols, n_dup, n_repeat = measures(text)
    n_lines = sum(bool(re.search(r"[^\x20\x09-\x0D]", line)) for line in text.split("\n"))
    return not (
        n_words < 50
        or 2 * n_repeat > n_words
        or 10 * n_symbols > 4 * n_words
        or 10 * sum(c.isupper() for c in text) > 4 * word_chars
        or 10 * n_dup > 6 * n_lines
    )


def one_of_each(rows):
    sets = [set(pm.shingles(r[1]).tolist()) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    least = {}
    for g, row in zip(group, rows):
        if g not in least or (row[0] is not None and (least[g][0] is None or row[0] < least[g][0])):
            least[g] = row
    return list(least.values())


def hidden(text, model):
    spans = [m.span() for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    spans += [m.span() for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [m.span() for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    for m in re.finditer(ss.CANDIDATE, text):
        ratio = brute_ratio(m[0], model)
        if ratio >= ss.LEAST_RATIO and ratio >= ss.LEAST_PER_PAIR * (len(m[0]) - 1):
            spans.append(m.span())
    out, end = [], 0
    for start, stop in sorted(spans):
        if start > end or not out:
            out += [text[end:start], "[SECRET]"]
        end = max(end, stop)
    return "".join(out) + text[end:]


def test_run_equals_plain_stages(spark, frame, tmp_path):
    rows, stay, go = planted()
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])
    pq.write_table(pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema), tmp_path / "documents.parquet")

    survivors = one_of_each([r for r in known_languages(rows) if good(r)])
    ids = Counter(r[0] for r in survivors)
    assert set(stay) <= set(ids) and not set(go) & set(ids)
    assert len(survivors) < len(rows) - 25
    model = ss.train(ss.labelled_samples(frame(SCHEMA, survivors)))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    wanted, n_secrets = [], 0
    for doc_id, text, *_ in survivors:
        clean = hidden(text, model)
        n_secrets += clean != text
        tokens = tokenizer.encode(clean, add_special_tokens=False).ids + [2]
        for piece, (start, length) in enumerate(packing.cut(len(tokens))):
            part = np.array(tokens[start : start + length], "<u4").tobytes()
            wanted.append((repr(doc_id), piece, start, length, zlib.crc32(part), part))
    assert n_secrets >= 5

    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    got = [(repr(r.doc_id), r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in found]
    assert sorted(got) == sorted(wanted)
    room = []
    for length in sorted((w[3] for w in wanted), reverse=True):
        fitting = min((r for r in room if r >= length), default=packing.CAPACITY)
        if fitting in room:
            room.remove(fitting)
        room.append(fitting - length)
    sequences = defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    assert len(sequences) == len(room)
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
