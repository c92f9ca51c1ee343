import bz2
import io
import json
import os
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusloom.sources import archives as A
from corpusloom.sources import readers as R


def put(path, content):
    mode = "wb" if isinstance(content, bytes) else "w"
    with open(path, mode, **({} if mode == "wb" else {"encoding": "utf-8"})) as f:
        f.write(content)
    return str(path)


def zipped(path, members):
    with zipfile.ZipFile(path, "w") as z:
        for name, content in members.items():
            z.writestr(name, content)
    return str(path)


def test_declared_sources(spark, tmp_path):
    put(tmp_path / "a.json", json.dumps([{"text": "One fine day.", "who": "Ann", "n": 7, "link": "https://x.example/1"}, {"text": " ", "who": "Bo", "n": 8}, {"text": None}]))
    put(tmp_path / "b.tsv", "t\tauthor\nHello \"you\"\tCy\n")
    put(tmp_path / "c.csv.bz2", bz2.compress(b"1;Packed text here\n"))
    put(tmp_path / "d.txt", "line one\n\nline two\n")
    put(tmp_path / "e.html", "<div>no</div><p>Yes <b>this</b></p><p>and that</p>")
    configs = R.load_configs(json.dumps([
        {"name": "A", "path": str(tmp_path / "a.json"), "format": "json", "author_field": "who", "id_field": "n", "url_template": "https://t.example/{n}/{who}", "license_name": "L"},
        {"name": "B", "path": str(tmp_path / "b.tsv"), "format": "tsv", "text_field": "t", "author_field": "author", "item_url": "https://b.example"},
        {"name": "C", "path": str(tmp_path / "c.csv.bz2"), "format": "csv", "delimiter": ";", "field_names": ["k", "text"], "id_field": "k"},
        {"name": "D", "path": str(tmp_path / "d.txt"), "format": "text", "max_items": 1},
        {"name": "E", "path": str(tmp_path / "e.html"), "format": "html", "element": "p"},
    ]))
    rows = R.read_all(spark, configs).collect()
    by = {}
    for r in rows:
        by.setdefault(r["source_name"], []).append(r)
    assert [(r["text"], r["source_author"], r["source_item_id"], r["source_url"]) for r in by["A"]] == [("One fine day.", "Ann", "7", "https://t.example/7/Ann")]
    assert by["B"][0]["source_url"] == "https://b.example" and by["B"][0]["source_author"] == "Cy"
    assert by["C"][0]["text"] == "Packed text here" and len(by["D"]) == 1
    assert sorted(r["text"] for r in by["E"]) == ["Yes this", "and that"]
    missing = {r["source_name"]: r["missing"] for r in R.missing_provenance(R.read_all(spark, configs)).collect()}
    assert "license_url" in missing["A"] and "source_author" in missing["C"]
    with pytest.raises(ValueError):
        R.load_configs('[{"name":"A","path":"","format":"x"},{"name":"A","path":"","format":"x"}]')


def test_sentence_dump(spark, tmp_path):
    path = put(tmp_path / "d.tsv.bz2", bz2.compress("1\teng\tHe said \"hi\" to me.\tann\t2020\n2\tfra\tNon.\tbo\nx\teng\tBad id.\tbo\n3\teng\tNo author.\t\\N\n4\teng\tNone here.\t\n".encode()))
    assert [tuple(r) for r in R.sentence_dump(spark, path).collect()] == [("1", 'He said "hi" to me.', "ann")]


def test_utterances_find_their_speakers(spark, tmp_path):
    u = put(tmp_path / "u.jsonl", "\n".join(json.dumps(x) for x in [{"id": "1", "text": "a", "speaker": "s1"}, {"id": "2", "text": "b", "speaker": {"id": "s2", "meta": {"name": "Own"}}}, {"id": "3", "text": "c", "speaker": "s3"}, {"id": "4", "text": "d"}]))
    s = put(tmp_path / "s.json", json.dumps({"s1": {"meta": {"name": "Meta"}}, "s2": {"name": "There"}}))
    assert {r["id"]: r["author"] for r in R.utterances(spark, u, s).collect()} == {"1": "Meta", "2": "Own", "3": "s3"}


def test_news_and_ebooks(spark, tmp_path):
    pages = spark.createDataFrame([(1, "Monday, March 5, 2030\nDr. A. Smith came. He left. " + " ".join(f"Line {i} ends." for i in range(9)))], "page_id int, extract string")
    got = R.news_extracts(pages).orderBy("pos").collect()
    assert [r["text"] for r in got[:2]] == ["Dr. A. Smith came.", "He left."] and len(got) == 6 and str(got[0]["dated"]) == "2030-03-05"
    put(tmp_path / "1.txt", "Title: T\nAuthor: Some One\n*** START OF THE EBOOK ***\nFirst here. Second one.\n\nNew part.\n*** END OF THE EBOOK ***\nnot this.")
    put(tmp_path / "2.txt", "*** START OF X\nNo author.\n*** END OF X")
    rows = R.ebook(spark, str(tmp_path / "*.txt")).orderBy("paragraph", "sentence").collect()
    assert [(r["author"], r["paragraph"], r["sentence"], r["text"]) for r in rows] == [("Some One", 0, 0, "First here."), ("Some One", 0, 1, "Second one."), ("Some One", 1, 0, "New part.")]


def test_visible_text_and_elements():
    html = "<p>Keep &amp; this</p><pre>code</pre><ul><li>item</li></ul><p>and <a href='x'>link</a> that<br/>too</p><script>no</script>"
    assert R.visible_text(html) == "Keep & this and that too"
    assert R.visible_text(None) == "" and R.element_texts("<p>a<p>b</p></p><p></p>", "p") == ["a b"]


def test_forum(spark):
    posts = spark.createDataFrame([(1, 1, "<p>First one. Second one.</p>", "<b><a>", 9, None), (2, 2, "<p>Answer.</p>", "<a>", 9, None), (3, 1, "<p>Third.</p>", "|zz|", 9, None), (4, 1, "<p>Fourth.</p>", "|b|", None, "guest")], "post_id int, kind int, body string, tags string, owner_id int, owner_name string")
    users = spark.createDataFrame([(9, "Nina")], "user_id int, name string")
    got = R.forum_sentences(posts, users, {"a": (1, "A"), "b": (2, "B")}).collect()
    assert sorted((r["post_id"], r["pos"], r["author"], r["scene"], r["text"]) for r in got) == [(1, 0, "Nina", "A", "First one."), (1, 1, "Nina", "A", "Second one."), (4, 0, "guest", "B", "Fourth.")]


def test_turns_ranges_services(spark):
    d = spark.createDataFrame([("k", "Doctor: How are you?\nPatient:  Fine.  Doctor: Good: bye.")], "id string, dialogue string")
    assert [(r["turn"], r["speaker"], r["utterance"]) for r in R.speaker_turns(d).collect()] == [(0, "Doctor", "How are you?"), (1, "Patient", "Fine."), (2, "Doctor", "Good: bye.")]
    tokens = spark.createDataFrame([("m", "a", i, f"w{i}", i == 300) for i in range(600)], "meeting string, speaker string, pos bigint, word string, punctuation boolean")
    segments = spark.createDataFrame([("s1", "m", "a", 254, 257), ("s2", "m", "a", 299, 300), ("s3", "m", "b", 0, 5)], "segment_id string, meeting string, speaker string, first bigint, last bigint")
    assert {r[0]: r[1] for r in R.token_ranges(tokens, segments).collect()} == {"s1": "w254 w255 w256 w257", "s2": "w299w300"}
    turns = spark.createDataFrame([(1, [("x",), ("x",)]), (2, [("x",), ("y",)]), (3, [])], "n int, frames array<struct<service: string>>")
    assert [(r["n"], r["service"]) for r in R.unambiguous_service(turns).collect()] == [(1, "x")]


def test_archives(spark, tmp_path):
    turns = [{"speaker": "USER", "utterance": "Hello."}, {"speaker": "SYSTEM", "utterance": "Hi."}]
    z = zipped(tmp_path / "t.zip", {"data/train/dialogues_1.json": json.dumps([{"dialogue_id": "D1", "turns": turns}]), "other.txt": "x"})
    rows = A.task_dialogues(A.archive_members(spark, z, ".*dialogues_.*")).collect()
    assert [tuple(r) for r in rows] == [("train:D1:turn:0", "USER", "Hello."), ("train:D1:turn:1", "SYSTEM", "Hi.")]
    z = zipped(tmp_path / "i.zip", {"data_full.json": json.dumps({"train": [["turn it on", "on"], ["go", "x"]], "val": []})})
    allowed = spark.createDataFrame([("on", "home")], "intent string, scene string")
    assert [(r["text"], r["scene"]) for r in R.labelled(A.intents(A.archive_members(spark, z)), ["intent"], allowed).collect()] == [("turn it on", "home")]
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode="w:gz") as t:
        data = "\n".join(json.dumps({"id": str(i), "locale": loc, "scenario": "s", "intent": "n", "utt": "u", "worker_id": "w"}) for i, loc in enumerate(["en-US", "de-DE"])).encode()
        info = tarfile.TarInfo("a/en.jsonl")
        info.size = len(data)
        t.addfile(info, io.BytesIO(data))
    members = A.archive_members(spark, put(tmp_path / "m.tar.gz", buffer.getvalue()))
    assert [r["id"] for r in A.localised_intents(members, "en-US").collect()] == ["0"]
    z = zipped(tmp_path / "q.zip", {"a.xml": "<Document><Focus>Flu</Focus><QAPairs><QAPair><Question>What is it?</Question><Answer>A cold.</Answer></QAPair></QAPairs></Document>"})
    assert [tuple(r) for r in A.question_answers(A.archive_members(spark, z)).collect()] == [("a.xml", "Flu", "What is it?", "A cold.")]
    z = zipped(tmp_path / "c.zip", {"MTS-train.csv": "ID,Dialogue\n1,\"Doctor: Hi.\nPatient: Hello.\"\n2,\n"})
    talks = A.clinical_dialogues(A.archive_members(spark, z))
    assert [(r["split"], r["speaker"], r["utterance"]) for r in R.speaker_turns(talks).collect()] == [("train", "Doctor", "Hi."), ("train", "Patient", "Hello.")]
    z = zipped(tmp_path / "w.zip", {"w.xml": '<x xmlns:nite="u"><w nite:id="w1">Hi</w><w nite:id="w2" punc="true">.</w></x>'})
    assert [(r["id"], r["word"], r["punctuation"]) for r in A.meeting_words(A.archive_members(spark, z)).collect()] == [("w1", "Hi", False), ("w2", ".", True)]
    docx = zipped(tmp_path / "d.docx", {"word/document.xml": '<d xmlns:w="u"><w:p><w:t>One </w:t><w:t>two</w:t></w:p><w:p/></d>'})
    assert [r["text"] for r in A.document_paragraphs(spark, docx).collect()] == ["One two"]
    md = put(tmp_path / "x.md", "# Head\n\nSee [this](http://x) now\nand then.\n\n- item")
    assert [r["text"] for r in A.markdown_paragraphs(spark, md).collect()] == ["Head", "See this now and then.", "item"]


@pytest.mark.parametrize("name", ["../x", "/etc/x", "a/../../x", "C:/x", "a\\..\\..\\x"])
def test_unsafe_members(name):
    with pytest.raises(ValueError):
        A.safe_member(name)


def test_locks_and_snapshots(spark, tmp_path):
    put(tmp_path / "one.txt", "1")
    before = A.file_lock(spark, str(tmp_path / "*.txt")).collect()
    locked = spark.createDataFrame(before)
    put(tmp_path / "one.txt", "2")
    put(tmp_path / "two.txt", "2")
    problems = {os.path.basename(r["path"]): r["problem"] for r in A.lock_problems(A.file_lock(spark, str(tmp_path / "*.txt")), locked).collect()}
    assert problems == {"one.txt": "changed", "two.txt": "new"}
    store = A.Snapshots(str(tmp_path / "store"), ("select", "translate"))
    df = spark.range(3)
    store.publish("select", df, expected=None, digest="g1")
    store.publish("translate", df, expected=None, digest="t1")
    with pytest.raises(RuntimeError):
        store.publish("select", df, expected=None, digest="g2")
    store.publish("select", df.filter("id > 0"), expected="g1", digest="g2")
    assert store.read(spark, "select").count() == 2
    first, second = A.Snapshots(str(tmp_path / "race"), ("select",)), A.Snapshots(str(tmp_path / "race"), ("select",))
    number = first._entry
    first._entry = lambda stage: (second.publish("select", df, expected=None, digest="other"), number(stage))[1] if not number(stage)[0] else (0, {})
    with pytest.raises(RuntimeError):  # the other writer came between reading and entering
        first.publish("select", df, expected="other", digest="late")
    assert second.generation("select") == "other"
    with pytest.raises(LookupError):
        store.read(spark, "translate")
    a, b, place = put(tmp_path / "n1", "new"), str(tmp_path / "gone"), put(tmp_path / "p1", "old")
    with pytest.raises(OSError):
        A.publish_together({a: place, b: str(tmp_path / "p2")})
    assert open(place).read() == "old"
    A.publish_together({put(tmp_path / "n3", "new"): place})
    assert open(place).read() == "new" and A.config_fingerprint({"a": 1, "b": 2}) == A.config_fingerprint({"b": 2, "a": 1})


def test_spoken_dialogues_check_their_index(spark, tmp_path):
    good = [{"conversation_id": "c", "instruction_id": "hotel-1", "utterances": [{"index": 0, "speaker": "USER", "text": "Hi"}]}, {"conversation_id": "d", "instruction_id": "x", "utterances": []}]
    assert [r["text"] for r in R.spoken_dialogues(spark, put(tmp_path / "g.json", json.dumps(good)), "hotel").collect()] == ["Hi"]
    good[0]["utterances"][0]["index"] = 1
    with pytest.raises(Exception, match="broken index"):
        R.spoken_dialogues(spark, put(tmp_path / "b.json", json.dumps(good)), "hotel").collect()


def test_legacy_and_science(spark, tmp_path):
    old = spark.createDataFrame([("h1", "a"), ("h2", "b")], "normalized_hash string, text string")
    assert R.legacy_import(old).filter("protected").count() == 2
    with pytest.raises(Exception, match="repeated hash"):
        R.legacy_import(old.union(old)).collect()
    spark.createDataFrame([("What  is it?", "x"), (None, "y")], "question string, support string").write.parquet(str(tmp_path / "s"))
    assert [r["text"] for r in R.science_questions(spark, str(tmp_path / "s")).collect()] == ["What is it?"]
    with pytest.raises(ValueError):
        R.science_questions(spark, str(tmp_path / "s2")) if spark.range(1).write.parquet(str(tmp_path / "s2")) is None else None
    assert F.lit(1) is not None


def test_malformed_members_are_errors(spark):
    members = spark.createDataFrame([("d/train/dialogues_1.json", "{not json")], "member string, content string")
    for read in (A.task_dialogues, A.daily_dialogues, A.intents, A.schema_guided):
        with pytest.raises(Exception, match="malformed JSON"):
            read(members).collect()


def test_speakers_in_any_case(spark):
    df = spark.createDataFrame([("DOCTOR: Hello. Patient: Hi there. physician: Sit. P: Yes. D : Good. Guest_family: We came.",)], "dialogue string")
    assert [r["speaker"] for r in R.speaker_turns(df).collect()] == ["DOCTOR", "Patient", "physician", "P", "D", "Guest_family"]


def test_services_are_described_by_their_own_split(spark):
    schema = [{"service_name": "Rides_1", "description": "Order a ride"}]
    members = spark.createDataFrame([("d/train/schema.json", json.dumps(schema))], "member string, content string")
    turns = lambda split: spark.createDataFrame([(split, "Rides_1", "Hi")], "split string, service string, text string")
    services = A.service_descriptions(members)
    assert [r["description"] for r in A.described_turns(turns("train"), services).collect()] == ["Order a ride"]
    with pytest.raises(Exception, match="no schema for dev/Rides_1"):
        A.described_turns(turns("dev"), services).collect()
