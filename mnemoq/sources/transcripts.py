"""Transcripts: JSON lines of two shapes to messages and sessions, offsets, and what to read next."""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemoq.sources import domain, line_files, store

GATE_TOKENS = 2000
EVENT = "type string, sessionId string, cwd string, gitBranch string, timestamp string, uuid string, isSidechain boolean, message struct<role:string, content:variant>, payload struct<id:string, cwd:string, type:string, role:string, content:variant>"


def read_lines(spark: SparkSession, path: str, split: str = "64m", **options: str) -> DataFrame:
    """(file, start, value, first): finished lines of the files at a path, each with its first byte and its file's first line."""
    line_files.register(spark)
    return spark.read.format("line_files").options(split=split, **options).load(path)


def catch_up(spark: SparkSession, own: str | None, shared: str | None, projects: list[str], split: str = "64m", ending: str = r"\.jsonl") -> DataFrame:
    """Messages of all sessions of some projects, from both kinds of folders: ``own`` holds the projects' transcripts of the first
    shape, of which those right in it count, not those of helpers in folders below; ``shared`` holds everybody's of the second
    shape, at any depth but in folders named subagents, and the first line tells the project. Of other projects' files a split
    reads the first line alone. A folder that is None or isn't there has no messages; ``new_rows`` tells what isn't stored yet."""
    at = F.regexp_replace("cwd", "(?<=.)/+$", "")
    parts = []
    if own:
        parts.append(parse(read_lines(spark, own, split, files=f"[^/]+{ending}")))
    if shared:
        named = "|".join(re.escape(json.dumps(p, ensure_ascii=a)[1:-1]) for p in projects for a in (True, False))
        lines = read_lines(spark, shared, split, files=f"(?!(?:.*/)?subagents/).+{ending}", first=rf'"cwd"\s*:\s*"(?:{named})/*"')
        parts.append(parse(lines.where(F.get_json_object("first", "$.type") == "session_meta")).where(at.isin(projects)))
    return reduce(DataFrame.unionByName, parts) if parts else parse(spark.createDataFrame([], line_files.SCHEMA))


def with_offsets(lines: DataFrame, by: str) -> DataFrame:
    w = W.partitionBy(by).orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    n = F.octet_length("value") + 1
    return lines.withColumn("start", (F.sum(n).over(w) - n).cast("long"))


def flatten(content: Column) -> Column:
    """A message's text: a string as it is; blocks of text, and of thinking with a mark, line by line."""
    blocks = F.from_json(F.to_json(content), "array<struct<type:string, text:string, thinking:string>>")
    parts = F.transform(blocks, lambda b: F.when(b["type"].isin("text", "input_text", "output_text"), b["text"]).when(b["type"] == "thinking", F.concat(F.lit("[thinking] "), b["thinking"])))
    text = F.array_join(F.filter(parts, lambda p: p.isNotNull()), "\n")
    return F.when(F.schema_of_variant(content) == "STRING", F.try_variant_get(content, "$", "string")).otherwise(text)


def parse(lines: DataFrame) -> DataFrame:
    """(id, session_id, cwd, role, content, ts, file, start) of (file, start, value, first), of either shape: the file's first line
    tells which. Within the row, so for streams, too. A message without an id of its own has its place as one."""
    e = lines.withColumns({"e": F.from_json("value", EVENT), "h": F.from_json("first", "type string, payload struct<id:string, cwd:string>")}).where("e is not null")
    meta, p = F.coalesce(F.col("h.type") == "session_meta", F.lit(False)), "e.payload"
    place = F.concat("file", F.lit("#"), F.col("start").cast("string"))
    one = ~meta & F.col("e.type").isin("user", "assistant") & F.col("e.sessionId").isNotNull() & ~F.coalesce("e.isSidechain", F.lit(False))
    two = meta & (F.col("e.type") == "response_item") & (F.col(f"{p}.type") == "message") & F.col(f"{p}.role").isin("user", "assistant")
    either = lambda a, b: F.when(meta, b).otherwise(a)
    return e.where(one | two).select(
        either(F.coalesce("e.uuid", place), F.concat(F.lit("codex-"), "h.payload.id", F.lit("-"), F.col("start").cast("string"))).alias("id"),
        either(F.col("e.sessionId"), F.col("h.payload.id")).alias("session_id"), either(F.col("e.cwd"), F.col("h.payload.cwd")).alias("cwd"),
        either(F.coalesce("e.message.role", "e.type"), F.col(f"{p}.role")).alias("role"),
        flatten(either(F.col("e.message.content"), F.col(f"{p}.content"))).alias("content"), F.col("e.timestamp").alias("ts"), "file", "start").where("content <> ''")


def sessions(messages: DataFrame) -> DataFrame:
    """The first line seen of a session names its folder and start."""
    return messages.groupBy("session_id").agg(F.min_by(F.struct("cwd", "ts"), F.struct("file", "start")).alias("s")).select(F.col("session_id").alias("id"), "s.cwd", F.col("s.ts").alias("started_at"))


def new_rows(found: DataFrame, stored: DataFrame) -> DataFrame:
    """Messages not stored yet, each once: reading a file again adds nothing."""
    return found.dropDuplicates(["id"]).join(stored.select("id"), "id", "left_anti")


def resume(now: DataFrame, log: DataFrame) -> DataFrame:
    """(path, start): where to read on; from the start for new, replaced or shortened files, null where nothing is new."""
    j = now.join(log.withColumnsRenamed({"inode": "_inode", "size": "_size", "offset": "_offset"}), "path", "left")
    again = F.col("_offset").isNull() | (F.col("inode") != F.col("_inode")) | (F.col("size") < F.col("_offset")) | (F.col("size") < F.col("_size"))
    return j.select("path", F.when(again, 0).when(F.col("size") > F.col("_offset"), F.col("_offset")).cast("long").alias("start"))


def latest(log: DataFrame, key: str, version: str) -> DataFrame:
    """An append-only log as the table it stands for: each key's last row."""
    cols = [c for c in log.columns if c not in (key, version)]
    return log.groupBy(key).agg(F.max_by(F.struct(version, *cols), version).alias("r")).select(key, f"r.{version}", *[f"r.{c}" for c in cols])


def brief(rules: DataFrame, bugs: DataFrame, decisions: DataFrame, n: int = 5) -> DataFrame:
    """(project, brief): the last n rules, open bugs and decisions of each project; no row, no brief."""
    def part(df: DataFrame, title: str, text: str, order: int) -> DataFrame:
        top = df.withColumn("_r", F.row_number().over(W.partitionBy("project").orderBy(F.desc("ts"), "id"))).where(F.col("_r") <= n)
        g = top.groupBy("project").agg(F.array_sort(F.collect_list(F.struct("_r", F.col(text).alias("t")))).alias("l"))
        return g.select("project", F.lit(order).alias("o"), F.concat(F.lit(f"## {title}\n"), F.array_join(F.transform("l", lambda x: F.concat(F.lit("- "), x["t"])), "\n")).alias("s"))

    parts = part(rules, "Do not repeat", "rule", 0).unionByName(part(bugs.where("not resolved"), "Open bugs", "summary", 1)).unionByName(part(decisions, "Decisions", "content", 2))
    return parts.groupBy("project").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "s"))), lambda x: x["s"]), "\n\n").alias("brief"))


# ---- queries -------------------------------------------------------------------------------------
def _json(s: SparkSession, d: str) -> DataFrame:
    """The conversations as a transcript's lines, one file for each; odd turns as blocks, every fifth a sidechain."""
    c = domain.read(s, d, "conversations")
    block = F.to_json(F.expr("array(named_struct('type', 'text', 'text', text, 'thinking', null), named_struct('type', 'thinking', 'text', null, 'thinking', 'so'), named_struct('type', 'tool_use', 'text', 'x', 'thinking', null))"))
    content = F.when(F.col("turn") % 2 == 1, block).otherwise(F.to_json(F.array("text")).substr(F.lit(2), F.length(F.to_json(F.array("text"))) - 2))
    line = F.concat(F.lit('{"type":"'), "role", F.lit('","sessionId":"'), "conv_id", F.lit('","uuid":"'), "conv_id", F.lit("-"), "turn", F.lit('","isSidechain":'), F.when((F.col("conv_id") + F.col("turn")) % 5 == 0, "true").otherwise("false"), F.lit(',"message":{"role":"'), "role", F.lit('","content":'), content, F.lit("}}"))
    return with_offsets(c.select(F.col("conv_id").cast("string").alias("file"), F.col("turn").alias("line_no"), line.alias("value")), "file").withColumn("first", F.lit("{}"))


def _laid_out(s: SparkSession, d: str) -> DataFrame:
    """The same lines, written to 16 text files in the shared folder and read again by byte ranges of 64 KB."""
    path = store.folder(s, "transcripts")
    rows = _json(s, d).withColumn("part", F.pmod(F.xxhash64("file"), F.lit(16)))
    rows.repartition(16, "part").sortWithinPartitions("part", "file", "line_no").select("value", "part").write.partitionBy("part").text(path)
    return read_lines(s, path, "64k")


def _caught_up(s: SparkSession, d: str) -> DataFrame:
    """Even conversations lie in the project's own folder, some again below subagents; odd ones in the shared folder, a file for
    each of seven projects with the project in its first line. Six of the seven are asked for."""
    path, odd = store.folder(s, "clients"), domain.read(s, d, "conversations").where("conv_id % 2 = 1").withColumn("part", F.col("conv_id") % 7)
    _json(s, d).where("file % 2 = 0").select("value").write.text(f"{path}/own")
    _json(s, d).where("file % 14 = 0").select("value").write.text(f"{path}/own/subagents")
    line = F.to_json(F.struct(F.lit("response_item").alias("type"), F.struct(F.lit("message").alias("type"), "role", F.col("text").alias("content")).alias("payload")))
    head = F.to_json(F.struct(F.lit("session_meta").alias("type"), F.struct(F.concat(F.lit("z"), "part").alias("id"), F.concat(F.lit("/p"), "part", F.lit("/")).alias("cwd")).alias("payload")))
    rows = odd.select("part", F.lit(1).alias("o"), line.alias("value")).unionByName(odd.select("part").distinct().select("part", F.lit(0).alias("o"), head.alias("value")))
    rows.repartition("part").sortWithinPartitions("part", "o").select("value", "part").write.partitionBy("part").text(f"{path}/shared")
    return catch_up(s, f"{path}/own", f"{path}/shared", [f"/p{k}" for k in range(1, 7)], "64k", r"\.txt")


def _log(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = domain.read(s, d, "customer")
    now = c.selectExpr("concat('/t/', c_custkey) as path", "c_nationkey as inode", "cast(c_custkey * 10 as bigint) as size")
    log = c.where("c_custkey % 3 <> 0").selectExpr("concat('/t/', c_custkey) as path", "if(c_custkey % 5 = 0, -1, c_nationkey) as inode", "cast(c_custkey * if(c_custkey % 7 = 0, 11, 10) as bigint) as size", "cast(c_custkey * (9 + c_custkey % 3) as bigint) as offset")
    return now, log


def _brief(s: SparkSession, d: str) -> DataFrame:
    r = domain.bugs(s, d).selectExpr("id", "project", "ts", "summary as rule")
    return brief(r, domain.bugs(s, d), domain.context_items(s, d).where("kind = 'decision'"))


def _sessions(s: SparkSession, d: str) -> DataFrame:
    return sessions(domain.read(s, d, "events").selectExpr("user_id as session_id", "event_type as cwd", "value as ts", "'' as file", "event_id as start"))


QUERIES = {
    "a7_parse_json": lambda s, d: parse(_json(s, d)).select("id", "session_id", "role", F.sha2(F.col("content").cast("binary"), 256).alias("sha")),
    "a8_byte_offsets": lambda s, d: with_offsets(domain.read(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "value")), "doc_id").select("doc_id", "line_no", "start"),
    "a10_resume": lambda s, d: resume(*_log(s, d)),
    "a12_latest": lambda s, d: latest(domain.read(s, d, "events").selectExpr("user_id", "event_id", "event_type", "value"), "user_id", "event_id"),
    "a11_line_source": lambda s, d: parse(_laid_out(s, d)).select("id", "session_id", "role", F.sha2(F.col("content").cast("binary"), 256).alias("sha")),
    "a13_first_session": _sessions,
    "a32_catch_up": lambda s, d: _caught_up(s, d).select("session_id", "cwd", "role", F.sha2(F.col("content").cast("binary"), 256).alias("sha")),
    "b12_brief": _brief,
}
_part = lambda view, title, text, o, w: f"SELECT project, {o} AS o, '## {title}' || chr(10) || string_agg('- ' || {text}, chr(10) ORDER BY r) AS s FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY ts DESC, id) AS r FROM {view} WHERE {w}) WHERE r <= 5 GROUP BY project"
ORACLES = {
    "a7_parse_json": "SELECT conv_id || '-' || turn AS id, conv_id::VARCHAR AS session_id, role, sha256(CASE WHEN turn % 2 = 1 THEN text || chr(10) || '[thinking] so' ELSE text END) AS sha FROM conversations WHERE role IN ('user', 'assistant') AND (conv_id + turn) % 5 <> 0 AND (turn % 2 = 1 OR text <> '')",
    "a8_byte_offsets": "SELECT doc_id, i::INT AS line_no, (sum(n) OVER (PARTITION BY doc_id ORDER BY i) - n)::BIGINT AS start FROM (SELECT doc_id, i - 1 AS i, strlen(l[i]) + 1 AS n FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))",
    "a10_resume": "SELECT '/t/' || c_custkey AS path, CASE WHEN c_custkey % 3 = 0 OR c_custkey % 5 = 0 OR c_custkey % 7 = 0 OR c_custkey * 10 < c_custkey * (9 + c_custkey % 3) THEN 0 WHEN c_custkey * 10 > c_custkey * (9 + c_custkey % 3) THEN c_custkey * (9 + c_custkey % 3) END::BIGINT AS start FROM customer",
    "a12_latest": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1",
    "a13_first_session": "SELECT user_id AS id, arg_min(event_type, event_id) AS cwd, arg_min(value, event_id) AS started_at FROM events GROUP BY 1",
    "b12_brief": f"""{domain.duck('bugs', 'context_items')}, p AS ({_part('bugs', 'Do not repeat', 'summary', 0, 'true')} UNION ALL {_part('bugs', 'Open bugs', 'summary', 1, 'NOT resolved')} UNION ALL {_part('context_items', 'Decisions', 'content', 2, "kind = 'decision'")})
SELECT project, string_agg(s, chr(10) || chr(10) ORDER BY o) AS brief FROM p GROUP BY project""",
}
ORACLES["a32_catch_up"] = f"""SELECT session_id, NULL::VARCHAR AS cwd, role, sha FROM ({ORACLES['a7_parse_json']} AND conv_id % 2 = 0)
    UNION ALL SELECT 'z' || (conv_id % 7), '/p' || (conv_id % 7) || '/', role, sha256(text) FROM conversations WHERE conv_id % 2 = 1 AND conv_id % 7 > 0 AND role IN ('user', 'assistant') AND text <> ''"""
ORACLES["a11_line_source"] = ORACLES["a7_parse_json"]
