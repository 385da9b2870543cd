"""Each stage of the pipeline against a brute-force version on its own input."""

import zlib
from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline as P
from statforge.llm.common import staged
from statforge.llm.mixing import mix_sql
from statforge.llm.quality_rules import MEASURE_SQL, RULES
from statforge.llm.token_ids import tokenizer_path

from .oracle import duck
from .test_minhash_dedup import brute as brute_components
from .test_suffix_dedup import SPAN

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, seen = docs.columns, [docs]
    for name, stage in P.STAGES:
        seen.append(staged(stage(spark, seen[-1], SF), name.replace(" ", "-")))
    for out in seen[1:-1]:
        assert out.columns == names
    # quality rules
    bad = " OR ".join(f"({r})" for r in RULES.values())
    want = {r[0] for r in duck(documents=docs).execute(f"WITH {MEASURE_SQL.replace('{docs}', 'documents')} SELECT doc_id FROM measures WHERE NOT ({bad})").fetchall()}
    assert set(rows_of(seen[1])) == want
    # one of each near-duplicate group
    groups = brute_components([(r.doc_id, r.text) for r in seen[1].collect()], 5, 80)
    assert set(rows_of(seen[2])) == {d for d, _, _, kept in groups if kept}
    # passages
    first, before = {}, rows_of(seen[2])
    for d, r in before.items():
        b = r.text.encode()
        for i in range(len(b) - SPAN + 1):
            first[b[i : i + SPAN]] = min(first.get(b[i : i + SPAN], d), d)
    for d, r in rows_of(seen[3]).items():
        b = before[d].text.encode()
        gone = bytearray(len(b))
        for i in range(len(b) - SPAN + 1):
            if first[b[i : i + SPAN]] < d:
                gone[i : i + SPAN] = b"\1" * SPAN
        assert r.text == bytes(c for c, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore") and r.n_chars == len(r.text)
    assert len(rows_of(seen[3])) == len(before)
    # mixing repeats whole rows as often as the SQL of the plan says
    assert set(rows_of(seen[4])) == set(before)
    want = duck(documents=seen[3]).execute(f"WITH RECURSIVE {mix_sql('documents', P.REPETITION)} SELECT doc_id, text FROM mixed").fetchall()
    assert Counter((r.doc_id, r.text) for r in seen[4].collect()) == Counter(want)
    # packing places every id of every copy once, in sequences without gaps
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    ids = {r.doc_id: [*tokenizer.encode(r.text, add_special_tokens=False).ids, 1] for r in seen[4].collect()}
    copies = Counter(r.doc_id for r in seen[4].collect())
    placed, sequences = Counter(), defaultdict(list)
    for p in seen[5].collect():
        part = ids[p.doc_id][p.start : p.start + p.length]
        assert p.length > 0 and p.doc_tokens == len(ids[p.doc_id]) and p.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        placed.update((p.doc_id, i) for i in range(p.start, p.start + p.length))
        sequences[p.sequence_id].append((p.offset, p.length))
    assert placed == {(d, i): copies[d] for d, x in ids.items() for i in range(len(x))}
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048


def test_run(spark):
    assert P.run(spark, SF).count() > 0
