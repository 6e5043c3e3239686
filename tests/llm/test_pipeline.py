import hashlib
import random

import corpus_pipeline
from meshwright.llm import bpe
from meshwright.llm.common import cut
from meshwright.llm.queries import vocabulary


def test_stages(spark, tmp_path):
    r = random.Random(8)
    say = lambda: " ".join("".join(r.choice("etaoinsh") for _ in range(r.randint(3, 8))) for _ in range(60))
    good = [say() for _ in range(80)]
    texts = [*good, *[t + " more" for t in good[:10]], *[say().upper().replace(" ", "!! ") for _ in range(40)], say() + " write to jo.doe@mail.example.com " + say()]
    rows = [(k, t, "en", f"src{k % 3}", len(t)) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k < 90), 0) for k in range(0, 130, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        new = cut(stage(spark, docs, str(tmp_path)))
        assert new.columns == docs.columns
        docs = new
        seen.append(sorted((x.doc_id, x.text) for x in docs.collect()))
    ids = [[k for k, _ in s] for s in seen]
    assert not set(ids[0]) & set(range(90, 130)) and len(set(ids[0]) & set(range(90))) >= 85
    assert ids[1] == [k for k in ids[0] if not (80 <= k < 90 and k - 80 in ids[0])]
    assert ids[2] == ids[1] and all("@" not in t and (k == 130 or t == texts[k]) for k, t in seen[2])
    assert set(ids[3]) <= set(ids[2])
    tok = bpe.codec(vocabulary()).tok
    want = sorted((k, hashlib.sha256(" ".join(map(str, tok.encode(t, add_special_tokens=False).ids)).encode()).hexdigest()) for k, t in seen[3])
    got = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert sorted((x.doc_id, x.ids_sha256) for x in got.collect()) == want
