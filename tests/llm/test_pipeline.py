"""The corpus pipeline, from end to end, against plain Python."""

import base64
import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
from hourgrid.llm import bpe, mixing, queries
from test_entry import rows_elsewhere

BAD = ["gremlok", "vashtun", "plorgit"]
SYLLABLES = ["the", "ra", "lo", "in", "ter", "mi", "sen", "qua", "é", "ou", "zu"]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(n))


def fixture():
    """Documents (with nulls, empty texts, copies, near copies, shared passages) and labels; which ones are toxic."""
    r = random.Random(7)
    rows, labels, toxic = [], [], set()
    passage = prose(900, 40)
    for i in range(300):
        words = prose(i, r.randint(30, 60)).split()
        if i % 4 == 1:
            for w in r.sample(BAD, 2):
                words.insert(r.randint(0, 30), w)
            toxic.add(i)
        text = " ".join(words)
        if i % 4 == 0 and i % 3 == 0 and i:
            text = rows[i - 12][1] if i % 24 == 0 else rows[i - 12][1] + " end"  # copies and near copies of a clean text
        elif i % 10 == 2:
            text = text + " " + passage + " " + prose(5000 + i, 8)
        rows.append([i, text, ["en", "fr", None][i % 3], f"src{i % 5}", len(text)])
        labels.append((i, None, int(i in toxic)))
    rows += [[400, None, "en", "src1", None], [401, "", "en", "src1", 0], [402, "one two", None, None, 7], [None, "no id here " + prose(77, 30), "fr", "src2", 0]]
    return rows, labels, toxic


def alike(a, b):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())

    a, b = shingles(a), shingles(b)
    return bool(a and b) and 100 * len(a & b) >= 80 * len(a | b)


def without_near_copies(rows):
    known = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])
    group = {r[0]: r[0] for r in known}
    for k, a in enumerate(known):
        for b in known[k + 1 :]:
            if group[a[0]] != group[b[0]] and alike(a[1], b[1]):
                low, high = sorted((group[a[0]], group[b[0]]))
                group = {i: low if g == high else g for i, g in group.items()}
    return [r for r in rows if r[0] is None or group[r[0]] == r[0]]


def without_repeats(rows):
    seen, out = set(), []
    for r in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        data, text = (r[1] or "").encode(), r[1] or ""
        gone = np.zeros(len(data) + 1, bool)
        for s in range(len(data) - 99):
            gone[s : s + 100] |= data[s : s + 100] in seen
            seen.add(data[s : s + 100])
        lead = np.cumsum([0, *(len(c.encode()) for c in text)])
        out.append([r[0], "".join(c for k, c in enumerate(text) if not gone[lead[k] : lead[k + 1]].all()), *r[2:]])
    return out


def deal(budget, children):
    """{name: (weight, capacity)} -> {name: share}; what the small ones cannot take goes to their siblings."""
    out, left = {}, dict(children)
    while left:
        name = min(left, key=lambda k: (left[k][1] / left[k][0], k))
        weight, capacity = left[name]
        total = sum(w for w, _ in left.values())
        if capacity * total > budget * weight:
            return out | {k: min(c, budget * w // total) for k, (w, c) in left.items()}
        out[name], budget = capacity, budget - capacity
        del left[name]
    return out


def mixed(rows):
    """Nine tenths of the tokens, each document once at most."""
    words = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    leaf = lambda r: ("none" if not r[3] else mixing.DOMAINS[ord(r[3][-1]) % 4], r[2] or "", r[3] or "")
    tokens = defaultdict(int)
    for r in rows:
        tokens[leaf(r)] += words(r)
    budgets = {(): int(sum(tokens.values()) * 0.9)}
    for depth, level in enumerate(mixing.LEVELS):
        for path, budget in [b for b in budgets.items() if len(b[0]) == depth]:
            children = defaultdict(int)
            for k, n in tokens.items():
                if k[:depth] == path and n:
                    children[k[depth]] += n
            shares = deal(budget, {c: (mixing.WEIGHTS[level].get(c, 1), n) for c, n in children.items()})
            budgets |= {(*path, c): b for c, b in shares.items()}
    out = []
    for k in tokens:
        mine, budget = [r for r in rows if leaf(r) == k and words(r)], budgets.get(k, 0)
        if budget == tokens[k]:
            out += mine
            continue
        key = lambda r: hashlib.md5(f"17:0:{'' if r[0] is None else r[0]}".encode()).hexdigest()
        used = 0
        for r in sorted(mine, key=key):
            used += words(r)
            if used > budget:
                break
            out.append(r)
    return out


def test_pipeline_equals_plain_python(spark, tmp_path):
    rows, labels, toxic = fixture()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    want = [r for r in rows if r[0] not in toxic]
    at, found = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, str(tmp_path))
        if name != "tokens":
            assert at.columns == docs.columns
            want = {"toxicity": lambda x: x, "near_duplicates": without_near_copies, "repeated_passages": without_repeats, "mixing": mixed}[name](want)
            found[name] = at.select("doc_id", "text").collect()
            assert sorted((r.doc_id or -1, r.text or "") for r in found[name]) == sorted((r[0] or -1, r[1] or "") for r in want), name
    assert len(found["near_duplicates"]) < len(found["toxicity"]) and len(found["mixing"]) < len(found["repeated_passages"])
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(bpe.VOCABULARY), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id or -1, list(r.ids)) for r in got) == sorted((r[0] or -1, library.encode_ordinary(r[1] or "")) for r in want)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    fields = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame([], fields).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_and_queries_are_registered():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "repeated_passages", "mixing", "tokens"]
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 14))


def test_workers_get_the_operators(tmp_path):
    of_documents, of_vectors = ("op1_language_id", "op2_media", "op3_bpe", "op6_suffix_dedup", "op7_toxicity"), ("op9_embedding_neardup", "op11_vector_codes")
    got = rows_elsewhere(tmp_path, *of_documents, *of_vectors, "op12_spelling_variants", "op13_url_filter")
    assert got.pop("op12_spelling_variants") > 1000 and got == dict.fromkeys(of_documents, 200) | dict.fromkeys(of_vectors, 500) | {"op13_url_filter": 50}
