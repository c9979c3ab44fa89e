"""The node store, and verdicts that follow changes."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import corpus
from lectern.plans import made
from lectern.plans.documents import KNOWN
from lectern.sources.store import NodeStore
from lectern.streaming.incremental import CHANGES, LiveVerdicts

D = "/root/testdata/sf0.001"
FILES = "path string, content string"


def rows(df):
    return sorted((str(r.asDict(recursive=True)) for r in df.select(sorted(df.columns)).collect()))


def plain(df):
    return df.withColumn("attrs", F.to_json(F.array_sort(F.map_entries("attrs"))))


@pytest.fixture
def live(spark, tmp_path):
    return LiveVerdicts(spark, f"file://{tmp_path}/live", KNOWN.checks)


def test_store_parses_each_text_once(spark, tmp_path):
    files = made.files(spark, D).union(spark.createDataFrame([("twin.html", "<p>x"), ("other/twin.html", "<p>x"), ("none.html", None), ("note.txt", "<p>y")], FILES))
    store = NodeStore(spark, f"file://{tmp_path}/s", buckets=3)
    got = store.nodes(files)
    assert rows(plain(got)) == rows(plain(corpus.nodes(files)))
    html = files.where("path like '%.html'")
    distinct = html.select(F.coalesce("content", F.lit(""))).distinct().count()
    assert store.hashes().count() == distinct and store.add(html) == 0
    again = NodeStore(spark, f"file://{tmp_path}/s", buckets=3)
    assert again.add(html.union(spark.createDataFrame([("new.html", "<p>z"), ("copy.html", "<p>z")], FILES))) == 1
    assert again.hashes().count() == distinct + 1


def test_store_is_read_in_buckets_and_by_column(spark, tmp_path):
    store = NodeStore(spark, f"file://{tmp_path}/s")
    files = made.files(spark, D)
    nodes = store.nodes(files)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = nodes.groupBy("tag").count()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    scan = [x for x in plan.split("\n") if "FileScan parquet spark_catalog" in x]
    assert len(scan) == 1 and "Bucketed: true" in scan[0] and "text_content" not in scan[0]
    assert "struct<sha:string,kind:string,tag:string>" in scan[0] and "MapInArrow" not in plan


def test_store_keeps_what_is_referred_to(spark, tmp_path):
    store = NodeStore(spark, f"file://{tmp_path}/s", buckets=2)
    files = spark.createDataFrame([("a.html", "<p>a"), ("b.html", "<p>b"), ("c.html", "<p>b"), ("d.html", "")], FILES)
    store.nodes(files)
    kept = files.where("path in ('c.html', 'd.html')")
    assert store.retain(kept) == 1 and store.retain(kept) == 0 and store.version == 1
    assert {r.path for r in store.nodes(kept).collect()} == {"c.html"}
    assert store.add(files) == 1
    broken = tmp_path / "s" / "nodes-2" / "v7"
    broken.mkdir()  # a version that was not completed
    assert NodeStore(spark, f"file://{tmp_path}/s", buckets=2).version == 1
    store.dispose()
    assert not (tmp_path / "s" / "nodes-2").exists()


def expected(spark, state):
    files = spark.createDataFrame(sorted(state.items()), FILES)
    return rows(corpus.verdicts(files, corpus.nodes(files), KNOWN.checks))


TEMPLATE = '<template id="t"><t-a required></t-a>{}</template>'


def test_a_changed_template_judges_its_documents_only(spark, live):
    doc = '<t-x data-conforms-to="t.template.html#t"><t-a>1</t-a>{}</t-x>'
    state = {f"d{i}.html": doc.format("<t-b>2</t-b>" if i % 2 else "") for i in range(6)}
    state |= {f"u{i}.html": f'<u-x data-conforms-to="u.template.html#u">{i}</u-x>' for i in range(5)} | {"t.template.html": TEMPLATE.format(""), "note.css": "x"}
    put = lambda d: spark.createDataFrame([(p, c, 0) for p, c in d.items()], CHANGES)
    assert live.apply(put(state), 0) == {"changed": 13, "parsed": 8, "judged": 12}
    assert rows(live.verdicts()) == expected(spark, state)

    new = {"t.template.html": TEMPLATE.format("<t-b></t-b>")}
    state |= new
    assert live.apply(put(new), 1) == {"changed": 1, "parsed": 1, "judged": 7}
    assert rows(live.verdicts()) == expected(spark, state)
    assert live.verdicts().where("path like 'd%' and not ok").count() == 0

    new = {"u.template.html": '<template id="u"></template>'}  # until now missing
    state |= new
    assert live.apply(put(new), 2) == {"changed": 1, "parsed": 1, "judged": 6}
    assert rows(live.verdicts()) == expected(spark, state)

    assert live.apply(put({"t.template.html": None, "d1.html": None, "never.html": None}), 3) == {"changed": 2, "parsed": 0, "judged": 5}
    del state["t.template.html"], state["d1.html"]
    assert rows(live.verdicts()) == expected(spark, state)

    same = {"d2.html": state["d2.html"]}
    assert live.apply(put(same), 4) == {"changed": 0, "parsed": 0, "judged": 0}
    moved = {"d2.html": state["d3.html"]}  # a text that the store has
    state |= moved
    assert live.apply(put(moved), 5) == {"changed": 1, "parsed": 0, "judged": 1}
    assert live.apply(put(moved), 5) == {"changed": 1, "parsed": 0, "judged": 1}  # run again
    assert rows(live.verdicts()) == expected(spark, state)

    live.compact()
    assert rows(live.verdicts()) == expected(spark, state)
    assert live.store.hashes().count() == len({c for p, c in state.items() if p.endswith(".html")})
    back = {"t.template.html": TEMPLATE.format("")}
    state |= back
    live.apply(put(back), 6)
    assert rows(live.verdicts()) == expected(spark, state)


def test_any_sequence_of_batches_agrees_with_the_final_files(spark, live, tmp_path):
    """Change files of a stream: templates and documents come, change and go at random, some twice in a batch."""
    rng = random.Random(11)
    texts = [made.FILES["templates/customer.template.html"], made.FILES["templates/customer.template.html"].replace("required", ""), "<p></p>"]
    documents = [r.content for r in made.files(spark, D).where("path like 'customers/%'").limit(12).collect()]
    state, seq = {}, 0
    source = f"file://{tmp_path}/changes"
    for _ in range(6):
        batch = []
        for _ in range(rng.randint(1, 8)):
            seq += 1
            if rng.random() < 0.3:
                path, content = "templates/customer.template.html", rng.choice([*texts, None])
            else:
                path, content = f"customers/{rng.randrange(10)}.html", rng.choice([*documents, None])
            batch.append((path, content, seq))
            state[path] = content
        spark.createDataFrame(batch, CHANGES).coalesce(1).write.mode("append").parquet(source)
    told = []
    live.follow(source, f"file://{tmp_path}/checkpoint", files_at_once=1, told=lambda n, c: told.append(c)).awaitTermination()
    state = {p: c for p, c in state.items() if c is not None}
    assert rows(live.verdicts()) == expected(spark, state) and len(told) == 6
    assert {r.path for r in live.files().collect()} == set(state)
    assert sum(c["parsed"] for c in told) <= len(texts) + len(documents)
