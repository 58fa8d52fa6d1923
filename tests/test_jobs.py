import json

from pyspark.sql import functions as F

from vitaeflow.fixed_values import RECORD_KEY
from vitaeflow.operators import extraction, models
from vitaeflow.plans import jobs
from vitaeflow.schema import CANDIDATES, CHUNKS, STORED_DOCUMENTS
from vitaeflow.sources import files
from vitaeflow.sources.tables import KeyedTable
from vitaeflow.streaming.intake import start_intake


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def write(folder, **documents):
    for name, text in documents.items():
        (folder / f"{name}.pdf").write_bytes(text.encode())


def extract_pages(data):
    if data == b"broken":
        raise ValueError("no pages")
    return data.decode().split("|")


def reader_model():
    """Answers ``name/key`` documents with a record, others with prose."""

    def answer(prompts):
        import json as j

        out = []
        for prompt in prompts:
            body = prompt.rsplit("Currículum:\n", 1)[1].split("\n")[0]
            name, _, key = body.partition("/")
            out.append("```json\n" + j.dumps({"Nombre": name, "RUN del postulante": key}) + "\n```" if key else "sin datos")
        return out

    return models.chat_model(answer)


def letters(texts):
    return [[float(t.count(c)) for c in "abcdefgh"] for t in texts]


def stores(spark, name):
    return (KeyedTable(spark, f"{name}_candidates", CANDIDATES, RECORD_KEY, 4).create(),
            KeyedTable(spark, f"{name}_chunks", CHUNKS, "RUN", 4).create(), f"{name}_staging")


def test_from_files_to_answers(spark, tmp_path):
    write(tmp_path, one="ada/1-9|cc", two="bea/2-7|hh", three="plain", four=" | ", five="broken", six="eva/ ")
    texts = jobs.read_documents(files.document_files(spark, str(tmp_path)), extract_pages)
    records = jobs.extract_records(texts, reader_model())
    assert rows(records, "pdf_name", "Nombre", "error") == [
        ("five.pdf", None, "unreadable document: no pages"), ("four.pdf", None, "document has no text"),
        ("one.pdf", "ada", None), ("six.pdf", "eva", None), ("three.pdf", None, "no JSON object in reply"),
        ("two.pdf", "bea", None)]
    assert records.where("pdf_name = 'three.pdf'").first()["raw"] == "sin datos"

    held, indexed, staging = stores(spark, "files")
    two = records.where("pdf_name = 'two.pdf'").first()["path"]
    fixes = spark.createDataFrame([(two, "3-5")], ["path", RECORD_KEY])
    done = jobs.load_records(extraction.accepted(records), texts, held, indexed, staging, letters, corrections=fixes, size=6)
    assert rows(done.changes, "RUN", "action") == [("1-9", "NEW"), ("3-5", "NEW")]
    assert rows(done.invalid, "pdf_name") == [("six.pdf",)]
    assert rows(indexed.read(), "RUN", "chunk_no", "text") == [
        ("1-9", 0, "ada/1-"), ("1-9", 1, "9\ncc\n"), ("3-5", 0, "bea/2-"), ("3-5", 1, "7\nhh\n")]
    assert spark.table(staging).count() == 0

    stored = KeyedTable(spark, "files_stored", STORED_DOCUMENTS, "run_norm", 4).create()
    reviewed = extraction.accepted(records).where("Nombre <> 'bea'")
    jobs.store_documents(files.document_files(spark, str(tmp_path)), reviewed, stored)
    assert [(r["run_norm"], bytes(r["content"])) for r in stored.read().collect()] == [("19", b"ada/1-9|cc")]

    questions = spark.createDataFrame([("q1", "ccc"), ("q2", "hhh")], "query_id STRING, question STRING")
    echo = models.chat_model(lambda prompts: ["says " + p.split("'")[1].split("\n")[1] for p in prompts])
    for source in (indexed, indexed.read()):
        answered, hits = jobs.answer_questions(questions, source, letters, echo, k=1, template=("'", "'"))
        assert rows(answered, "query_id", "answer_text") == [("q1", "says cc\n"), ("q2", "says hh\n")]
        assert hits.where("error IS NOT NULL").count() == 0


def test_second_load_refreshes_only_changed_keys(spark):
    held, indexed, staging = stores(spark, "again")
    calls = spark.sparkContext.accumulator(0)

    def counted(texts):
        calls.add(len(texts))
        return letters(texts)

    def load(*people):
        made = spark.createDataFrame([(n, k, f, t) for n, k, f, t in people], ["Nombre", RECORD_KEY, "pdf_name", "text"])
        records = made.select(*[F.col(f"`{f.name}`") if f.name in made.columns else F.lit("-").alias(f.name) for f in CANDIDATES.fields],
                              F.current_timestamp().alias("ingest_ts"))
        return jobs.load_records(records, made.select("pdf_name", "text"), held, indexed, staging, counted)

    load(("a", "1", "f1", "aa"), ("b", "2", "f2", "bb"))
    assert calls.value == 2
    done = load(("a2", "1", "f3", "cc"), ("c", "3", "f4", "dd"))
    assert rows(done.changes, "RUN", "action") == [("1", "UPDATED"), ("3", "NEW")]
    assert calls.value == 4
    assert rows(indexed.read(), "RUN", "text") == [("1", "cc"), ("2", "bb"), ("3", "dd")]
    assert rows(held.read(), RECORD_KEY, "Nombre") == [("1", "a2"), ("2", "b"), ("3", "c")]


def test_failed_embedding_keeps_the_old_rows(spark):
    held, indexed, staging = stores(spark, "failing")

    def embedder(texts):
        if any("boom" in t for t in texts):
            raise RuntimeError("refused")
        return letters(texts)

    def load(name, text):
        made = spark.createDataFrame([(name, "1", name, text)], ["Nombre", RECORD_KEY, "pdf_name", "text"])
        records = made.select(*[F.col(f"`{f.name}`") if f.name in made.columns else F.lit("-").alias(f.name) for f in CANDIDATES.fields],
                              F.current_timestamp().alias("ingest_ts"))
        return jobs.load_records(records, made.select("pdf_name", "text"), held, indexed, staging, embedder)

    load("first", "aa")
    done = load("second", "boom")
    assert rows(done.failed_chunks, "RUN", "error") == [("1", "model call failed: refused")]
    assert rows(indexed.read(), "RUN", "text") == [("1", "aa")]


def reviewed(spark, *people):
    """Records and texts of ``(name, key, path, pdf_name, text)``."""
    made = spark.createDataFrame(list(people), ["Nombre", RECORD_KEY, "path", "pdf_name", "text"])
    records = made.select(*[F.col(f"`{f.name}`") if f.name in made.columns else F.lit("-").alias(f.name) for f in CANDIDATES.fields],
                          F.current_timestamp().alias("ingest_ts"), "path")
    return records, made.select("path", "pdf_name", "text")


def test_files_of_one_name_stay_apart(spark, tmp_path):
    for folder, text in (("x", "ana/1-9|aa"), ("y", "benito/2-7|bb")):
        (tmp_path / folder).mkdir()
        write(tmp_path / folder, cv=text)
    inbox = files.document_files(spark, str(tmp_path))
    texts = jobs.read_documents(inbox, extract_pages)
    records = jobs.extract_records(texts, reader_model())
    held, indexed, staging = stores(spark, "one_name")
    fixes = spark.createDataFrame([(records.where("Nombre = 'ana'").first()["path"], "Santiago")], "path STRING, Ciudad STRING")
    jobs.load_records(extraction.accepted(records), texts, held, indexed, staging, letters, corrections=fixes)
    assert rows(indexed.read(), "RUN", "chunk_no", "text") == [("1-9", 0, "ana/1-9\naa\n"), ("2-7", 0, "benito/2-7\nbb\n")]
    assert rows(held.read(), "Nombre", "Ciudad") == [("ana", "Santiago"), ("benito", "No especificado")]
    stored = KeyedTable(spark, "one_name_stored", STORED_DOCUMENTS, "run_norm", 4).create()
    jobs.store_documents(inbox, records, stored)
    assert sorted((r["run_norm"], bytes(r["content"])) for r in stored.read().collect()) == [("19", b"ana/1-9|aa"), ("27", b"benito/2-7|bb")]


def test_a_load_leaves_rows_of_another_alone(spark):
    held, indexed, staging = stores(spark, "apart")
    load = lambda *people: jobs.load_records(*reviewed(spark, *people), held, indexed, staging, letters)
    load(("old", "1", "p1", "n", "old"))
    dead, _ = reviewed(spark, ("dead", "1", "p9", "n", "new"))
    from vitaeflow.schema import STAGING
    from vitaeflow.sources import tables

    tables.stage_rows(dead.select(*[F.col(f"`{f.name}`") for f in STAGING.fields]), staging)
    done = load(("b", "2", "p2", "n", "bb"))
    assert rows(done.changes, "RUN") == [("2",)]
    assert rows(held.read(), RECORD_KEY, "Nombre") == [("1", "old"), ("2", "b")] and spark.table(staging).count() == 1


def test_an_emptied_document_loses_its_chunks(spark):
    held, indexed, staging = stores(spark, "emptied")
    load = lambda *people: jobs.load_records(*reviewed(spark, *people), held, indexed, staging, letters)
    load(("a", "1", "p1", "n", "aa"), ("b", "2", "p2", "n", "bb"), ("c", "3", "p3", "n", "cc"))
    load(("a2", "1", "p4", "n", ""), ("b2", "2", "p5", "n", None))
    assert rows(indexed.read(), "RUN", "text") == [("2", "bb"), ("3", "cc")]  # a missing text is not an empty one


def test_refused_questions_come_back(spark):
    def embedder(texts):
        if any("no" in t for t in texts):
            raise RuntimeError("refused")
        return letters(texts)

    held = jobs.index_texts(spark.createDataFrame([("1", "aa"), ("2", "bad a")], "RUN STRING, text STRING"), letters)

    def summing(payloads):
        if any("bad" in p for p in payloads):
            raise RuntimeError("no summary")
        return models.chat_model(lambda prompts: ["sum"] * len(prompts))(payloads)

    questions = spark.createDataFrame([("q1", "a"), ("q2", "no")], "query_id STRING, question STRING")
    answered, hits = jobs.answer_questions(questions, held, embedder, summing)
    assert rows(answered, "query_id", "answer_text", "failed_hits") == [("q1", "sum\n", 1)]
    lost = {(r["query_id"], r["RUN"]): r["error"] for r in hits.where("error IS NOT NULL").collect()}
    assert lost == {("q1", "2"): "model call failed: no summary", ("q2", None): "model call failed: refused"}


def test_stream_rejects_have_failed_chunks(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    held, indexed, staging = stores(spark, "lost")

    def embedder(texts):
        if any("boom" in t for t in texts):
            raise RuntimeError("refused")
        return letters(texts)

    write(inbox, one="ada/1-9|boom", two="eva/2-7")
    kept = []
    stream = jobs.read_documents(files.document_file_stream(spark, str(inbox)), extract_pages)
    start_intake(stream, str(tmp_path / "checkpoint"), reader_model(), embedder, held, indexed, staging,
                 lambda batch, _: kept.extend(rows(batch, RECORD_KEY, "error"))).awaitTermination()
    assert kept == [("1-9", "chunks not embedded: model call failed: refused")]
    assert rows(indexed.read(), "RUN") == [("2-7",)] and held.read().count() == 2


def test_stream_twice(spark, tmp_path):
    inbox, checkpoint = tmp_path / "inbox", str(tmp_path / "checkpoint")
    inbox.mkdir()
    held, indexed, staging = stores(spark, "stream")
    kept, adaptive = [], []

    def note(batch, _):
        kept.extend(rows(batch, "pdf_name", "error"))
        adaptive.append(batch.sparkSession.conf.get("spark.sql.adaptive.enabled"))

    def run():
        stream = jobs.read_documents(files.document_file_stream(spark, str(inbox)), extract_pages)
        query = start_intake(stream, checkpoint, reader_model(), letters, held, indexed, staging,
                             rejects=note)
        query.awaitTermination()
        return rows(held.read(), RECORD_KEY, "Nombre"), rows(indexed.read(), "RUN", "text")

    write(inbox, one="ada/1-9", two="plain", three="eva/ ")
    first = run()
    assert first == ([("1-9", "ada")], [("1-9", "ada/1-9\n")])
    assert sorted(kept) == [("three.pdf", "no usable key"), ("two.pdf", "no JSON object in reply")]
    assert run() == first and len(kept) == 2
    assert adaptive == ["true"]
    write(inbox, four="ada maria/1-9|b", five="leo/5-1")
    assert run() == ([("1-9", "ada maria"), ("5-1", "leo")], [("1-9", "ada maria/1-9\nb\n"), ("5-1", "leo/5-1\n")])


def test_model_is_asked_once_per_document(spark):
    calls = spark.sparkContext.accumulator(0)
    inner = reader_model()

    def model(payloads):
        calls.add(len(payloads))
        assert all(json.loads(p)["max_tokens"] == 2000 for p in payloads)
        return inner(payloads)

    texts = spark.createDataFrame([(f"f{i}", None, f"n{i}/{i}\n") for i in range(10)], "pdf_name STRING, ingest_ts TIMESTAMP, text STRING")
    records = jobs.extract_records(texts, model)
    assert records.count() == 10 and extraction.rejected(records).count() == 0
    records.collect()
    assert calls.value == 10
