"""Queries over files, caller-supplied functions and streaming jobs.

Every job reads rows derived from the given tables; folders lie below the checkpoint folder.
"""

from __future__ import annotations

import re
import uuid

from pyarrow import fs as pafs
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from chainloom.functions import content as ct
from chainloom.operators import archive as ar
from chainloom.operators import chain as ch
from chainloom.operators import condense as cd
from chainloom.operators import model as md
from chainloom.operators import prune as pr
from chainloom.operators import reveal as rv
from chainloom.operators import rewrite as rw
from chainloom.operators import symbols as sy
from chainloom.operators.storage import checkpoint_root, materialise
from chainloom.plans import archive_queries as aq
from chainloom.plans import condense_queries as cq
from chainloom.plans import prune_queries as pq
from chainloom.plans import symbol_queries as sq
from chainloom.plans.registry import ORACLES, query
from chainloom.plans.turn_queries import linear
from chainloom.plans.views import query as sql
from chainloom.plans.views import view
from chainloom.sources import notes as nf
from chainloom.sources import projects as pj
from chainloom.sources import transcripts as tr
from chainloom.streaming import jobs


def folder(spark, label):
    return f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"


# ---- transcripts on disk --------------------------------------------------------------------


def _written(spark, sf):
    path = folder(spark, "transcripts")
    tr.write_transcripts(cq.raw_lines(spark, sf), path)
    return path


@query("read_transcripts", ORACLES["normalise_messages"].replace("SELECT conv, line, uuid", "SELECT CAST(conv AS VARCHAR) AS conv, line, uuid"), expanded=True)
def read_transcripts(spark, sf):
    return tr.read_transcripts(spark, _written(spark, sf)).select(
        "conv", "line", "uuid", "parent_uuid", "type", "role", "is_corrupt", "bad_ts", "shape", "opens_turn", "real_user", "plain_chars", "n_tool_use", "typed_text"
    )


@query("read_transcript_keys", "SELECT CAST(conv AS VARCHAR) AS conv, line, uuid, parent_uuid, type, TIMESTAMP '2026-01-01 00:00:00' + INTERVAL 1 SECOND * (line%10) AS ts FROM f1_messages")
def read_transcript_keys(spark, sf):
    return tr.read_transcript_keys(spark, _written(spark, sf)).drop("bad_ts")


# ---- changed transcripts: written, read again and compared --------------------------------------


def _stored(spark, sf, name="f2_messages", bad="conv % 3 = 0", **more):
    """Messages of a view, or of a table, after one trip through JSONL, with fields the engine does not know and unreadable lines."""
    m = view(spark, sf, name) if isinstance(name, str) else name
    message = ct.json_object({"role": ct.quoted(F.col("type")), "content": ct.quoted(F.col("text")), "model": F.lit('"m 1"')})
    raw = ct.json_object(
        {
            "uuid": ct.quoted(F.col("uuid")), "parentUuid": ct.quoted(F.col("parent_uuid")), "type": ct.quoted(F.col("type")), "x": F.lit('{"n":1.50,"l":[]}'),
            "timestamp": ct.json_time(F.col("ts"), "bigint"), "message": message, "isSidechain": F.lit("false"), **more,
        }
    )
    lines = m.select("conv", "line", raw.alias("raw"))
    ends = m.filter(bad).groupBy("conv").agg((F.max("line") + 1).alias("line"))
    return _trip(spark, lines.unionByName(ends.withColumn("raw", F.lit('{"uuid":"broken'))))


def _trip(spark, messages):
    path = folder(spark, "transcripts")
    tr.write_transcripts(messages, path)
    return tr.read_transcripts(spark, path)


def _walked(spark, messages, *more):
    """The chain of rewritten messages after a trip through files, with the number of unreadable lines."""
    again = materialise(_trip(spark, messages), "again")
    bad = again.groupBy("conv").agg(F.count_if("is_corrupt").alias("bad"))
    rows = ch.chain_messages(again, ch.walk_chain(again))
    return rows.join(bad, "conv").select("conv", "pos", "uuid", "text", "bad", *more)


def _chained(spark, sf):
    m = materialise(_stored(spark, sf), "stored")
    return m, ch.chain_messages(m, ch.walk_chain(m))


_BAD = "CASE WHEN c.conv % 3 = 0 THEN 1 ELSE 0 END AS bad"


@query("written_prune", f"WITH {pq._PERCENT} SELECT CAST(c.conv AS VARCHAR) AS conv, c.pos - coalesce(p.root_pos, 1) + 1 AS pos, c.uuid, c.text, {_BAD} FROM c JOIN p ON p.conv = c.conv WHERE c.pos >= coalesce(p.root_pos, 1)")
def written_prune(spark, sf):
    return _walked(spark, pr.prune_oldest_percent(*_chained(spark, sf), 40)[0])


@query(
    "written_sandwich",
    f"""WITH {pq._SANDWICH}, u AS (SELECT c.conv, CASE WHEN verdict='pruned' AND c.pos >= recent THEN c.pos - s.k + 1 ELSE c.pos END AS pos, c.uuid, c.text, CAST(NULL AS VARCHAR) AS backup
          FROM c JOIN p ON p.conv=c.conv LEFT JOIN s ON s.conv=c.conv WHERE c.uuid NOT IN (SELECT uuid FROM mid)
        UNION ALL SELECT g.conv, 2, bid, '[Pruned segment: '||s.k||' messages, '||make_timestamp(s.a*1000000)||' → '||make_timestamp(s.b*1000000)||'. Backup file: b'||g.conv||'.jsonl. Located at: /kept (path may have moved).]', '/kept/b'||g.conv||'.jsonl' FROM g JOIN s ON s.conv=g.conv)
        SELECT CAST(c.conv AS VARCHAR) AS conv, pos, uuid, text, {_BAD}, backup FROM u c""",
)
def written_sandwich(spark, sf):
    m, rows = _chained(spark, sf)
    name = F.concat(F.lit("b"), F.col("conv"), F.lit(".jsonl"))
    out = pr.sandwich_prune(m, rows, 1, 2, backup_file=name, backup_folder="/kept")[0]
    return _walked(spark, out, F.get_json_object("raw", "$._backupPath").alias("backup"))


@query(
    "written_inject",
    f"""WITH {pq._ROOT.replace("max(line) AS l", "max(line) + CASE WHEN conv%3=0 THEN 1 ELSE 0 END AS l")} SELECT CAST(c.conv AS VARCHAR) AS conv, 1 AS pos, id AS uuid, 'carry on' AS text, {_BAD}, 'main' AS git_branch, '2.1.50' AS version, ''||conv AS session_id FROM n c""",
)
def written_inject(spark, sf):
    return _walked(spark, pr.inject_root(*_chained(spark, sf), "carry on", F.lit("2030-01-01").cast("timestamp"))[0], "git_branch", "version", "session_id")


@query(
    "written_handoff",
    f"WITH {pq._HAND.format(x=0)} SELECT CAST(c.conv AS VARCHAR) AS conv, c.pos - coalesce(q.anc, 1) + 1 AS pos, c.uuid, c.text, {_BAD} FROM c JOIN q ON q.conv = c.conv WHERE c.pos >= coalesce(q.anc, 1)",
)
def written_handoff(spark, sf):
    marked = view(spark, sf, "f2_messages").withColumn("text", F.expr(pq._MARK))
    m = materialise(_stored(spark, sf, marked), "stored")
    return _walked(spark, pr.prune_to_handoff(m, ch.chain_messages(m, ch.walk_chain(m)), window=2)[0])


@query(
    "written_restore",
    f"""WITH {pq._RESTORE} SELECT CAST(c.conv AS VARCHAR) AS conv, CASE WHEN verdict='no_compaction' OR verdict='restored' AND c.line<2 THEN c.line + 1 ELSE c.line - 1 END AS pos, c.uuid, c.text, {_BAD}
        FROM m c JOIN p ON p.conv = c.conv WHERE CASE verdict WHEN 'no_compaction' THEN TRUE WHEN 'restored' THEN c.line NOT IN (2, 3) ELSE c.line >= 2 END""",
)
def written_restore(spark, sf):
    m = sql(spark, sf, pq._COMPACT)
    fields = {"subtype": F.when(F.col("is_boundary"), '"compact_boundary"'), "logicalParentUuid": ct.quoted(F.col("logical_parent_uuid"))}
    m = materialise(_stored(spark, sf, m, **{k: F.coalesce(v, F.lit("null")) for k, v in fields.items()}), "stored")
    return _walked(spark, pr.restore_compaction(m, ch.chain_messages(m, ch.walk_chain(m)))[0])


@query(
    "written_orphans",
    f"""WITH {pq._ROOT.replace("max(line) AS l", "max(line) + CASE WHEN conv%3=0 THEN 1 ELSE 0 END AS l")} SELECT CAST(conv AS VARCHAR) AS conv, 1 AS pos, id AS uuid, 'carry on' AS text FROM n
        UNION ALL SELECT CAST(conv AS VARCHAR), 2, 'child', 'going on' FROM n""",
)
def written_orphans(spark, sf):
    """A new root is injected, a child is written under it, and all lines but theirs are removed."""
    m, roots = pr.inject_root(*_chained(spark, sf), "carry on", F.lit("2030-01-01").cast("timestamp"))
    message = ct.json_object({"role": F.lit('"assistant"'), "content": F.lit('"going on"')})
    raw = ct.json_object(
        {"uuid": F.lit('"child"'), "parentUuid": ct.quoted(F.col("uuid")), "type": F.lit('"assistant"'), "timestamp": F.lit('"2030-01-02T00:00:00.000Z"'), "message": message}
    )
    ends = m.groupBy("conv").agg((F.max("line") + 1).alias("line"))
    child = roots.join(ends, "conv").select("conv", "line", raw.alias("raw"), F.lit("child").alias("uuid"), F.col("uuid").alias("parent_uuid"), F.lit("assistant").alias("type"))
    again = materialise(_trip(spark, pr.prune_orphan_lines(m.unionByName(child, allowMissingColumns=True), roots)), "again")
    return ch.chain_messages(again, ch.walk_chain(again)).select("conv", "pos", "uuid", "text")


@query(
    "written_plan",
    f"""WITH {aq._APPLY} SELECT CAST(l.conv AS VARCHAR) AS conv, l.line, l.uuid, CASE WHEN w.code IS NULL AND pg AND coalesce(act,'')<>'drop' THEN np ELSE l.parent_uuid END AS parent_uuid,
          CASE WHEN w.code IS NULL AND act='distill' THEN nt ELSE text END AS text, CASE WHEN w.code IS NULL AND act='distill' THEN 'true' END AS distilled, '1.5' AS n FROM l LEFT JOIN w ON w.conv=l.conv""",
)
def written_plan(spark, sf):
    m = materialise(_stored(spark, sf, "f1_messages", "false"), "stored")
    as_text = F.col("conv").cast("string")
    rows, entries, tools = (t.withColumn("conv", as_text) for t in (aq.turned(spark, sf), aq.entries(spark, sf)[0], sql(spark, sf, aq._TOOLS)))
    again = _trip(spark, ar.apply_plan(m, rows, entries, tools)[0])
    return again.select("conv", "line", "uuid", "parent_uuid", "text", F.get_json_object("raw", "$._archiveDistilled").alias("distilled"), F.get_json_object("raw", "$.x.n").alias("n"))


@query(
    "written_condense",
    f"""SELECT CAST(conv AS VARCHAR) AS conv, line, uuid, CASE {cq._KIND} WHEN 5 THEN 'gone '||uuid WHEN 3 THEN 'thought'||chr(10)||'{{"z":1.5,"command":"ls"}}' ELSE {cq._TEXT} END AS text,
          CASE {cq._KIND} WHEN 5 THEN 'reads' WHEN 3 THEN 'thinking' END AS source FROM f1_messages""",
)
def written_condense(spark, sf):
    m = materialise(_trip(spark, cq.raw_lines(spark, sf)), "stored")
    kind = (F.col("conv").cast("long") + F.col("line")) % 6
    change = m.filter(kind.isin(3, 5)).select(
        "conv", "uuid", F.lit(0).alias("block_idx"), F.when(kind == 5, "reads").otherwise("thinking").alias("mode"),
        F.when(kind == 5, F.concat(F.lit("gone "), "uuid")).otherwise(F.lit("thought")).alias("new_value"),
    )
    again = _trip(spark, rw.rewrite(m, replace=cd.apply_to_raw(m, change))[0])
    return again.select("conv", "line", "uuid", "text", F.get_json_object("raw", "$._condenseSource").alias("source"))


# ---- files on disk --------------------------------------------------------------------------


def _write_files(df, root):
    """Write ``df(path, content)`` as files below ``root``, in tasks; a repeated task writes the same file.

    Gives ``root`` back with its scheme, which tasks on other machines need to read the files.
    """

    def put(batches):
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                target = f"{top}/{path}"
                disk.create_dir(target.rsplit("/", 1)[0], recursive=True)
                with disk.open_output_stream(target) as f:
                    f.write(content.encode())
            yield batch[["path"]]

    disk, top = pafs.FileSystem.from_uri(root)
    df.select("path", "content").mapInPandas(put, "path string").write.format("noop").mode("overwrite").save()
    return root


@query("scan_project", "SELECT project, path, 'javascript' AS lang, 8 AS lines, strlen(content) AS size FROM f6_files UNION ALL SELECT project, 'pkg/__init__.py', 'python', 1, strlen(project) FROM (SELECT DISTINCT project FROM f6_files) p")
def scan_project(spark, sf):
    files = view(spark, sf, "f6_files")
    hidden = files.select("project").distinct().select(F.concat("project", F.lit("/pkg/__init__.py")).alias("path"), F.col("project").alias("content"))
    skipped = files.select(F.concat("project", F.lit("/node_modules/"), "path").alias("path"), "content")
    root = _write_files(files.select(F.concat_ws("/", "project", "path").alias("path"), "content").unionByName(hidden).unionByName(skipped), folder(spark, "projects"))
    return pj.scan_project(spark, root).select("project", "path", "lang", "lines", "size")


@query("scan_notes", "SELECT CASE WHEN tier='sidecar' THEN 'sidecar' ELSE 'section' END AS tier, CASE WHEN tier='sidecar' THEN 'src/n'||note_id||'.py.note' ELSE tier||'/n'||note_id||'.md' END AS ref, content FROM f7_notes")
def scan_notes(spark, sf):
    notes = view(spark, sf, "f7_notes")
    name = F.concat(F.lit("n"), F.col("note_id").cast("string"))
    path = F.when(F.col("tier") == "sidecar", F.concat(F.lit("code/src/"), name, F.lit(".py.note"))).otherwise(F.concat(F.lit("docs/"), "tier", F.lit("/"), name, F.lit(".md")))
    root = _write_files(notes.select(path.alias("path"), "content"), folder(spark, "notes"))
    return nf.scan_notes(spark, {"section": (f"{root}/docs", "*.md"), "sidecar": (f"{root}/code", "*.note")}).drop("modified")


# ---- caller-supplied functions --------------------------------------------------------------


def _summary(tool, args, content):
    if tool == "Bash":
        raise ValueError("no summaries of shell output")
    return {"summary": f"{tool} gave {len(content)}", "usage": {"input_tokens": len(content), "output_tokens": 3}}


@query(
    "summarize_blocks",
    f"""WITH {cq._K} SELECT conv, result_uuid AS uuid, CASE WHEN tool='Bash' THEN repeat('ab',60)||'...' ELSE tool||' gave '||chars END AS summary, tool='Bash' AS fallback,
        CASE WHEN tool='Bash' THEN 'no summaries of shell output' END AS error, CASE WHEN tool='Bash' THEN 0 ELSE chars END AS input_tokens, CASE WHEN tool='Bash' THEN 0 ELSE 3 END AS output_tokens FROM k WHERE chars>=600 AND {cq._OLD}""",
)
def summarize_blocks(spark, sf):
    blocks = cq.call_blocks(spark, sf)
    targets = cd.with_bodies(cd.refetch_targets(cd.pair_calls(blocks)), blocks)
    return md.summarize_blocks(targets, _summary).select("conv", "uuid", "summary", "fallback", "error", "input_tokens", "output_tokens")


def _score(turn_id, skeleton):
    if len(skeleton) % 7 == 0:
        return {"type": "gossip", "importance": "supporting", "summary": "", "value_score": 1}
    return {"type": "planning", "importance": "supporting", "summary": f"turn {turn_id}", "value_score": len(skeleton) % 101, "key_artifacts": [{"kind": "text", "text": "t"}], "duplicate_signal": "d"}


@query(
    "score_turns",
    """WITH e AS (SELECT conv, turn_id, string_agg('<entry uuid="'||uuid||'" role="'||type||'" ts="'||ts||'">'||chr(10)||text||chr(10)||'</entry>', chr(10)||chr(10) ORDER BY line) AS s FROM f8_turns GROUP BY 1,2)
       SELECT conv, turn_id, CASE WHEN length(s)%7<>0 THEN 'planning' END AS type, CASE WHEN length(s)%7<>0 THEN 'turn '||turn_id END AS summary, CASE WHEN length(s)%7<>0 THEN length(s)%101 END AS value_score, CASE WHEN length(s)%7=0 THEN 'bad type: gossip' END AS error FROM e""",
)
def score_turns(spark, sf):
    from chainloom.operators.turns import segment_turns

    entries = rv.compact_entries(segment_turns(linear(spark, sf)), None, "turn")
    return md.score_turns(rv.turn_skeletons(entries), _score).select("conv", "turn_id", "type", "summary", "value_score", "error")


# ---- streams --------------------------------------------------------------------------------


@query(
    "stream_token_meter",
    "SELECT conv_id AS conv, count(*) AS messages, CAST(sum(ceil(length(text)/4.0)) AS BIGINT) AS tokens FROM conversations GROUP BY 1",
)
def stream_token_meter(spark, sf):
    # through files of its own, because a stream reads fewer layouts of a table than a batch: none with folders below it
    arrived = sql(spark, sf, "SELECT conv_id AS conv, text FROM conversations")
    path = folder(spark, "meter-source")
    arrived.write.parquet(path)
    source = spark.readStream.schema(arrived.schema).parquet(path)
    out = folder(spark, "meter")

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/b{batch_id}")

    jobs.stream_token_meter(source, keep, folder(spark, "meter-state")).awaitTermination()
    rows = spark.read.option("recursiveFileLookup", "true").parquet(out)
    return rows.groupBy("conv").agg(F.max("messages").alias("messages"), F.max_by("tokens", "messages").alias("tokens"))


def _as_stream(spark, df, label, by, files=4):
    """``df`` as a stream of files, one a micro-batch; rows of one ``by`` arrive together."""
    path = folder(spark, label)
    df.repartition(files, by).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query("stream_code_check", ORACLES["check_code"], expanded=True)
def stream_code_check(spark, sf):
    files = materialise(sq.code_files(spark, sf), "files")
    out = folder(spark, "warnings")
    jobs.stream_code_check(
        _as_stream(spark, files, "edits", "path"), sql(spark, sf, sq._KNOWN), sql(spark, sf, sq._API), files, out, folder(spark, "edits-state")
    ).awaitTermination()
    return spark.read.option("recursiveFileLookup", "true").parquet(out)


# Blocks arrive in four batches by position; a batch may end between a call and its result.
_STEP = 15
_ARRIVES = f"least(3, CAST(floor((2*n-1)/{_STEP}.0) AS INT))"  # of a result, at position 2n


def _upto(b: int) -> str:
    """The plan over the calls answered by batch ``b``, less what earlier batches condensed."""
    reads, every = (re.sub(r"\b(FROM|JOIN) ([kr])\b", rf"\1 \g<2>{b}", text) for text in (cq._READS, cq._EVERY))
    earlier = " UNION ALL ".join(f"SELECT conv, uuid FROM win{i}" for i in range(b)) or "SELECT conv, uuid FROM e0 WHERE FALSE"
    return f"""k{b} AS (SELECT * FROM k WHERE {_ARRIVES}<={b}), {re.sub(r"^r AS", f"r{b} AS", reads)},
 e{b}(conv, uuid, rank, mode, original_bytes, condensed_bytes, new_value) AS ({every}),
 win{b} AS (SELECT *, CASE WHEN mode='refetch-markers' THEN original_bytes-condensed_bytes ELSE original_bytes END AS saved
   FROM (SELECT *, row_number() OVER (PARTITION BY conv, uuid ORDER BY rank) AS rn FROM e{b} WHERE (conv, uuid) NOT IN ({earlier})) t WHERE rn=1)"""


@query(
    "stream_condense",
    f"WITH {cq._K}, {', '.join(_upto(b) for b in range(4))} "
    + " UNION ALL ".join(f"SELECT conv, uuid, mode, saved, new_value, mode AS state_mode FROM win{b}" for b in range(4)),
)
def stream_condense(spark, sf):
    blocks = cq.call_blocks(spark, sf)
    arrives = F.least(F.lit(3), F.floor((F.col("pos") - 1) / _STEP)).cast("int")
    store = jobs.CondenseStore(spark, folder(spark, "condense"), blocks.schema)
    arriving = folder(spark, "blocks")
    state_of = folder(spark, "condense-state")
    for b in range(4):  # the files of a batch arrive together, and the stream goes on from its checkpoint
        blocks.filter(arrives == b).write.mode("append").parquet(arriving)
        jobs.stream_condense(spark.readStream.schema(blocks.schema).parquet(arriving), store, state_of).awaitTermination()
    # A batch that is run again after a failure finds the versions before it and writes the same rows.
    store.process(materialise(blocks.filter(arrives == 3), "replay"), 3)
    state = store.state().select("conv", "uuid", "block_idx", F.col("mode").alias("state_mode"))
    done = store.replacements().join(state, ["conv", "uuid", "block_idx"], "full")
    return done.select("conv", "uuid", "mode", "saved", "new_value", "state_mode")


@query("stream_reindex", sq.FULL_REINDEX)
def stream_reindex(spark, sf):
    lines = materialise(sq.project_lines(spark, sf), "lines")
    commits = lines.filter("ord%3=0 AND path < '/src/brand_3'").select("project", F.col("ord").alias("commit"))
    out = folder(spark, "registry")
    # The registry written before counts 100 usages too many; only projects with a commit are replaced.
    old = sy.build_registry(sy.extract_symbols(lines)).withColumn("usages", F.col("usages") + 100)
    old.write.partitionBy("project").parquet(out)
    jobs.stream_reindex(
        _as_stream(spark, commits, "commits", "project"), lambda p: lines.join(p, "project", "left_semi"), out, folder(spark, "commits-state")
    ).awaitTermination()
    return spark.read.schema(old.schema).parquet(out).select("project", "category", "name", "file", "line", "usages")
