import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkferry.llm import lang_id, secrets, toxicity
from sparkferry.llm.packing import default_tokenizer
from tests.llm.helpers import ODD, clashing, empty, odd
from tests.llm.test_duplicates import brute_groups
from tests.llm.test_media_secrets import OWN

FOLDER = "/root/testdata/sf0.01"


def test_run_equals_the_stages_done_by_hand(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    df = spark.read.parquet(f"{FOLDER}/documents.parquet")
    toxic = {r.doc_id for r in toxicity.score(df, toxicity.learn(df, labels)).where("predicted = 1").collect()}
    left = df.where(~F.col("doc_id").isin(list(toxic)))
    told = {r.doc_id for r in lang_id.identify(left, lang_id.learn(left)).collect() if r.lang_pred != "und" and r.score >= corpus_pipeline.LEAST_LANGUAGE}
    ids = sorted(told)
    groups = brute_groups([docs[i].text for i in ids])
    kept = [ids[k] for k in sorted(set(groups))]
    tokenizer = Tokenizer.from_file(default_tokenizer())
    want = {}
    for i in kept:
        text = secrets.redact(docs[i].text, secrets.spans_of(OWN, docs[i].text))
        want[i] = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
    got: dict = {}
    for r in corpus_pipeline.run(spark, FOLDER).collect():
        got.setdefault(r.doc_id, []).append((r.piece_start, np.frombuffer(bytes(r.ids), "<u4").tolist()))
    assert set(got) == set(want)
    assert all([x for _, part in sorted(got[i]) for x in part] == want[i] for i in want)


def test_stages_keep_the_columns(spark, tmp_path):
    labels = str(tmp_path)
    spark.read.parquet(f"{FOLDER}/labels.parquet").write.parquet(f"{labels}/labels.parquet")
    docs = clashing(odd(spark))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, labels)
        assert out.schema.names == docs.schema.names and out.count() <= len(ODD), name
        assert stage(spark, empty(spark), labels).count() == 0
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, docs, labels).select("doc_id").distinct().count() > 5 and last(spark, empty(spark), labels).count() == 0


def test_secrets_are_gone_and_counted(spark):
    docs = spark.createDataFrame([(1, "my password = hunter2222 ok", "en", "s", 27), (2, "fine", "en", "s", 4), (3, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.secrets(spark, docs, "").collect()}
    assert got == {1: ("my [assign] ok", 14), 2: ("fine", 4), 3: (None, None)}


def test_clean_documents_stay(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert corpus_pipeline.language(spark, docs, FOLDER).count() >= 0.995 * docs.count()
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").where("toxic = 0")
    clean = corpus_pipeline.toxicity(spark, docs, FOLDER).join(labels, "doc_id", "left_semi").count()
    assert clean >= 0.95 * labels.count()


def test_texts_in_no_learned_language_go(spark):
    r = np.random.default_rng(3)
    junk = lambda n: " ".join("".join(map(chr, r.integers(97, 123, r.integers(2, 10)))) for _ in range(n))
    strange = ["Η γρήγορη καφέ αλεπού πηδάει πάνω από το σκυλί", "敏捷的棕色狐狸跳过懒狗", "Съешь ещё этих мягких французских булок", junk(5), junk(30), junk(500), "aGVsbG8gd29ybGQgdGhpcyBpcyBhIGJhc2U2NCBzdHJpbmcgb2YgbGV0dGVycw=="]
    clean = ["Hello world", "Yes", "Der schnelle braune Fuchs springt über den faulen Hund.", "Une femme de la ville est dans la maison", "La casa de la ciudad es de la mujer"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    new = spark.createDataFrame([(-1 - i, s, None, None, len(s)) for i, s in enumerate(strange + clean)], docs.schema)
    left = {d.doc_id for d in corpus_pipeline.language(spark, docs.unionByName(new), FOLDER).select("doc_id").collect()}
    assert {i for i in left if i < 0} == {-1 - i for i in range(len(strange), len(strange) + len(clean))}
    assert len(left) - len(clean) >= 0.995 * docs.count()
