"""SQL of the catalog's queries for an independent engine, on the raw tables.

Written from the semantics, not from the operators: plain windows over whole
keys, correlated tests and joins, with no blocks or pre-aggregation.
"""

from __future__ import annotations

_TS = "'%Y-%m-%d %H:%M:%S.%f'"


def _text(column: str) -> str:
    return f"strftime({column}, {_TS})"


# Logical tables, one common table expression each.
_TABLES = {
    "meta": """
        SELECT CAST(o_orderkey AS VARCHAR) AS stream_id,
               CASE WHEN o_orderstatus = 'O' AND o_totalprice < 10000 THEN NULL
                    ELSE '/watch/' || o_orderkey || '.mp4' END AS original_path,
               CASE WHEN o_orderpriority <> '4-NOT SPECIFIED'
                    THEN md5(CAST(o_orderkey AS VARCHAR)) END AS s3_upload_id,
               'media' AS s3_bucket,
               'streams/' || o_orderkey || '/' || o_orderkey || '.mp4' AS s3_key_prefix,
               CASE WHEN o_orderstatus = 'O' THEN 'active'
                    WHEN o_orderstatus = 'P' THEN 'pending_completion'
                    WHEN o_orderpriority = '1-URGENT' THEN 'failed_failed_meta_upload'
                    WHEN o_orderpriority = '2-HIGH' THEN 's3_completed'
                    WHEN o_orderpriority = '3-MEDIUM' THEN 'interrupted_shutdown_write'
                    ELSE 'failed_chunk_processing_failure' END AS status,
               CAST(o_orderdate AS TIMESTAMP) AS started_at,
               CASE WHEN o_orderstatus = 'O' AND o_orderpriority = '3-MEDIUM' THEN NULL
                    ELSE CAST(o_orderdate AS TIMESTAMP)
                         + to_seconds(CAST(floor(o_totalprice) AS BIGINT)) END AS last_activity_at,
               CASE WHEN o_orderpriority <> '3-MEDIUM'
                    THEN CAST(floor(o_totalprice / 1000) AS BIGINT) END AS total_bytes_sent,
               CASE WHEN o_orderpriority <> '2-HIGH'
                    THEN CAST(floor(o_totalprice / 100000) AS INTEGER) + 1 END AS next_part_to_upload,
               CASE WHEN o_orderstatus <> 'F' THEN NULL
                    WHEN o_orderpriority = '1-URGENT' THEN 'failed_meta_upload'
                    WHEN o_orderpriority IN ('2-HIGH', '3-MEDIUM') THEN NULL
                    ELSE 'chunk_processing_failure' END AS failure_reason
        FROM orders""",
    "uploads": """
        SELECT CAST(l_orderkey AS VARCHAR) AS stream_id, l_linenumber AS part_number,
               md5(l_orderkey || '-' || l_partkey || '-' || l_suppkey) AS etag,
               CAST(l_quantity AS BIGINT) AS size_bytes,
               CAST(l_shipdate AS TIMESTAMP) AS uploaded_at
        FROM lineitem""",
    "parts": """
        SELECT * FROM uploads
        QUALIFY row_number() OVER (PARTITION BY stream_id, part_number
                ORDER BY uploaded_at DESC, etag DESC, size_bytes DESC) = 1""",
    "attempts": """
        SELECT CAST(l_orderkey AS VARCHAR) AS stream_id, l_linenumber AS part_number,
               CASE WHEN NOT (l_tax >= 0.08 AND l_returnflag = 'R')
                    THEN md5(l_orderkey || '-' || l_partkey || '-' || l_suppkey) END AS etag,
               CAST(l_quantity AS BIGINT) AS size_bytes,
               CAST(l_shipdate AS TIMESTAMP) AS uploaded_at
        FROM lineitem""",
    # A failed upload leaves no part, so it can't replace a good one.
    "good_attempts": """
        SELECT * FROM attempts WHERE etag <> ''
        QUALIFY row_number() OVER (PARTITION BY stream_id, part_number
                ORDER BY uploaded_at DESC, etag DESC, size_bytes DESC) = 1""",
    "part_outcomes": """
        SELECT * FROM good_attempts
        UNION ALL
        SELECT * FROM (
            SELECT * FROM attempts a
            WHERE NOT EXISTS (SELECT 1 FROM good_attempts g WHERE g.stream_id = a.stream_id
                              AND g.part_number = a.part_number)
            QUALIFY row_number() OVER (PARTITION BY stream_id, part_number
                    ORDER BY uploaded_at DESC, size_bytes DESC) = 1)""",
    "packed": """
        SELECT CAST(l_orderkey AS VARCHAR) AS stream_id,
               CASE WHEN l_linenumber = 4 AND l_returnflag = 'R' THEN 'abc'
                    ELSE CAST(l_linenumber AS VARCHAR) END AS part_key,
               CASE WHEN l_linenumber = 7 THEN tag || ':' || size
                    WHEN l_linenumber = 6 AND l_returnflag = 'R' THEN tag
                    WHEN l_linenumber = 5 AND l_returnflag = 'R' THEN tag || ':xyz:' || done_at
                    ELSE tag || ':' || size || ':' || done_at END AS packed
        FROM (SELECT *, md5(l_orderkey || '-' || l_partkey || '-' || l_suppkey) AS tag,
                     CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS size,
                     strftime(CAST(l_shipdate AS TIMESTAMP), '%Y-%m-%dT%H:%M:%S') AS done_at
              FROM lineitem)""",
    "pieces": """
        SELECT *, length(packed) - length(replace(packed, ':', '')) AS colons,
               strpos(packed, ':') AS c1,
               strpos(substr(packed, strpos(packed, ':') + 1), ':') AS c2
        FROM packed""",
    "typed": """
        SELECT stream_id, part_key, packed, TRY_CAST(part_key AS INTEGER) AS part_number,
               CASE WHEN c1 > 0 THEN substr(packed, 1, c1 - 1) ELSE packed END AS etag,
               CASE WHEN colons >= 2 THEN TRY_CAST(substr(packed, c1 + 1, c2 - 1) AS BIGINT)
                    WHEN colons = 1 THEN TRY_CAST(substr(packed, c1 + 1) AS BIGINT)
                    END AS size_bytes,
               CASE WHEN colons >= 2
                    THEN TRY_CAST(substr(packed, c1 + c2 + 1) AS TIMESTAMP) END AS uploaded_at,
               CASE WHEN colons = 0 THEN 'no_size_field'
                    WHEN TRY_CAST(part_key AS INTEGER) IS NULL THEN 'bad_part_number'
                    WHEN (CASE WHEN colons >= 2 THEN TRY_CAST(substr(packed, c1 + 1, c2 - 1) AS BIGINT)
                               ELSE TRY_CAST(substr(packed, c1 + 1) AS BIGINT) END) IS NULL
                    THEN 'bad_size' END AS reject_reason
        FROM pieces""",
    "files": """
        SELECT '/watch/' || l_orderkey || '.mp4' AS path,
               CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS size
        FROM lineitem GROUP BY l_orderkey""",
    "tracked": """
        SELECT '/watch/' || o_orderkey || '.mp4' AS path,
               CASE WHEN o_orderpriority = '2-HIGH' THEN 'other-' || o_orderkey
                    ELSE CAST(o_orderkey AS VARCHAR) END AS stream_id
        FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')""",
    "raw": """
        SELECT event_id AS seq, ts, '/watch/' || user_id || '.mp4' AS path,
               CASE event_type WHEN 'signup' THEN 'added' WHEN 'error' THEN 'deleted'
                    ELSE 'modified' END AS kind
        FROM events""",
    "seen": """
        SELECT *, lag(kind) OVER w AS prev,
               coalesce(sum(CASE WHEN kind = 'deleted' THEN 1 ELSE 0 END) OVER
                   (PARTITION BY path ORDER BY ts, seq
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gen
        FROM raw WINDOW w AS (PARTITION BY path ORDER BY ts, seq)""",
    "classified": """
        SELECT seq, ts, path, CAST(gen AS BIGINT) AS generation, 0 AS step, 'CREATE' AS event
        FROM seen WHERE kind <> 'deleted' AND (prev IS NULL OR prev = 'deleted')
        UNION ALL
        SELECT seq, ts, path, CAST(gen AS BIGINT),
               CASE WHEN prev IS NULL OR prev = 'deleted' THEN 1 ELSE 0 END, 'WRITE'
        FROM seen WHERE kind = 'modified'
        UNION ALL
        SELECT seq, ts, path, CAST(gen AS BIGINT), 0, 'DELETE' FROM seen WHERE kind = 'deleted'""",
    "feed": """
        SELECT event_id AS seq, ts, '/watch/' || user_id || '.mp4' AS path,
               CASE event_type WHEN 'signup' THEN 'CREATE' WHEN 'error' THEN 'DELETE'
                    ELSE 'WRITE' END AS event
        FROM events""",
    "generations": """
        SELECT seq, ts, path, event,
               CAST(coalesce(sum(CASE WHEN event = 'DELETE' THEN 1 ELSE 0 END) OVER
                   (PARTITION BY path ORDER BY ts, seq
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS generation
        FROM feed""",
    "routed": """
        SELECT seq, ts, path, event,
               CASE WHEN event = 'CREATE' THEN CASE WHEN open THEN 'ignore' ELSE 'open' END
                    WHEN event = 'WRITE' THEN CASE WHEN open THEN 'process' ELSE 'reopen' END
                    WHEN open THEN 'close' ELSE 'none' END AS action
        FROM (SELECT *, coalesce(lag(event) OVER (PARTITION BY path ORDER BY ts, seq), 'DELETE')
                        <> 'DELETE' AS open FROM feed)""",
    "open_paths": """
        SELECT '/watch/' || user_id || '.mp4' AS path, CAST(user_id AS VARCHAR) AS stream_id
        FROM (SELECT user_id, event_type, row_number() OVER
                  (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events)
        WHERE n = 1 AND event_type = 'purchase'""",
    "log": """
        SELECT CAST(user_id AS VARCHAR) AS stream_id, ts, event_id AS seq,
               CASE event_type WHEN 'signup' THEN 'active' WHEN 'click' THEN 'pending_completion'
                    WHEN 'purchase' THEN 'completed_with_meta'
                    WHEN 'view' THEN 'interrupted_cancelled_finalize'
                    ELSE 'failed_' || reason END AS status,
               CASE WHEN event_type = 'error' THEN reason END AS failure_reason
        FROM (SELECT *, CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) < 50
                             THEN 'finalize_s3_failure' ELSE 'chunk_processing_failure' END AS reason
              FROM events)""",
    "ops": """
        SELECT CAST(user_id AS VARCHAR) AS stream_id, ts, event_id AS seq,
               CASE WHEN k < 15 THEN 'open_stream' WHEN k < 30 THEN 'init_checkpoint'
                    WHEN k < 50 THEN 'write' WHEN k < 75 THEN 'finalize'
                    WHEN k < 82 THEN 'resume' WHEN k < 86 THEN 'task'
                    WHEN k < 89 THEN 'finalize_file_check' WHEN k < 92 THEN 'complete_upload'
                    WHEN k < 95 THEN 'metadata_generation' WHEN k < 98 THEN 'metadata_upload'
                    ELSE 'upload_part' END AS operation,
               CASE k % 7 WHEN 0 THEN 'S3OperationError' WHEN 1 THEN 'RedisOperationError'
                    WHEN 2 THEN 'FFprobeError' WHEN 3 THEN 'FileNotFoundError'
                    WHEN 4 THEN 'CancelledError' WHEN 5 THEN 'StreamInitializationError'
                    ELSE 'ValueError' END AS error_class
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
              FROM events WHERE event_type = 'error')""",
    "reasons": """
        SELECT *, CASE
            WHEN error_class = 'CancelledError' THEN NULL
            WHEN operation = 'open_stream' THEN
                CASE WHEN error_class IN ('S3OperationError', 'RedisOperationError',
                                          'StreamInitializationError')
                     THEN 'new_stream_unexpected_setup_failure' END
            WHEN operation = 'init_checkpoint' THEN
                CASE WHEN error_class = 'FileNotFoundError' THEN 'file_missing_on_resume'
                     WHEN error_class IN ('S3OperationError', 'RedisOperationError')
                     THEN 'init_checkpoint_client_failure' ELSE 'init_checkpoint_failure' END
            WHEN operation = 'write' THEN
                CASE WHEN error_class = 'FileNotFoundError' THEN NULL
                     WHEN error_class IN ('S3OperationError', 'RedisOperationError')
                     THEN 'chunk_processing_failure' ELSE 'chunk_processing_unexpected' END
            WHEN operation = 'finalize' THEN
                CASE error_class WHEN 'S3OperationError' THEN 'finalize_s3_failure'
                     WHEN 'RedisOperationError' THEN 'finalize_redis_failure'
                     WHEN 'FFprobeError' THEN 'finalize_ffprobe_failure'
                     ELSE 'finalize_unexpected_failure' END
            WHEN operation = 'resume' THEN
                CASE WHEN error_class NOT IN ('FileNotFoundError', 'StreamInitializationError')
                     THEN 'resume_init_unexpected_failure' END
            WHEN operation = 'task' THEN
                CASE WHEN error_class NOT IN ('StreamInitializationError', 'ChunkProcessingError',
                                              'StreamFinalizationError')
                     THEN 'task_unexpected_error' END
            WHEN operation = 'finalize_file_check' THEN 'finalize_file_missing'
            WHEN operation = 'complete_upload' THEN 'failed_s3_complete_internal'
            WHEN operation = 'metadata_generation' THEN 'failed_meta_generation'
            WHEN operation = 'metadata_upload' THEN 'failed_meta_upload' END AS failure_reason
        FROM ops""",
    "doc_chunks": """
        SELECT CAST(doc_id AS VARCHAR) AS stream_id, hex(encode(text)) AS data_hex,
               octet_length(encode(text)) AS size,
               CAST(i AS INTEGER) + 1 AS part_number, CAST(i * 1024 AS BIGINT) AS "offset",
               CAST(least(1024, octet_length(encode(text)) - i * 1024) AS BIGINT) AS length
        FROM documents, unnest(range(0, (octet_length(encode(text)) + 1023) // 1024)) AS r(i)""",
    "candidates": """
        SELECT stream_id FROM uploads
        UNION SELECT stream_id FROM meta WHERE status = 'pending_completion'""",
    "document_rows": """
        SELECT m.stream_id, m.original_path AS original_file_path, m.s3_bucket, m.s3_key_prefix,
               m.started_at, m.last_activity_at, p.part_number, p.size_bytes, p.etag, p.uploaded_at
        FROM meta m LEFT JOIN parts p USING (stream_id)""",
    "durations": """
        SELECT '/watch/' || o_orderkey || '.mp4' AS path,
               CAST(floor(o_totalprice / 100) AS DOUBLE) AS duration_seconds
        FROM orders WHERE o_orderpriority <> '5-LOW'""",
    "bursts": """
        SELECT path, ts, seq, sum(CASE WHEN prev IS NULL OR ts - prev > INTERVAL 6 HOURS
                                       THEN 1 ELSE 0 END)
               OVER (PARTITION BY path ORDER BY ts, seq) AS session_no
        FROM (SELECT *, lag(ts) OVER (PARTITION BY path ORDER BY ts, seq) AS prev FROM raw)""",
    "burst_bounds": """
        SELECT path, CAST(session_no AS BIGINT) AS session_no, min(ts) AS session_start,
               max(ts) + INTERVAL 6 HOURS AS session_end, count(*) AS events
        FROM bursts GROUP BY path, session_no""",
    "looked_up": """
        SELECT m.*, f.size AS file_size, t.stream_id AS tracked_id,
               epoch(TIMESTAMP '2001-08-01') - epoch(m.last_activity_at) AS age
        FROM meta m LEFT JOIN files f ON f.path = m.original_path
                    LEFT JOIN tracked t ON t.path = m.original_path""",
    "resumed": """
        SELECT c.stream_id, m.status, m.failure_reason, f.size AS file_size,
               t.stream_id AS tracked_id, m.stream_id IS NULL AS no_meta,
               m.original_path IS NULL OR m.s3_upload_id IS NULL OR m.s3_bucket IS NULL
                   OR m.s3_key_prefix IS NULL AS incomplete
        FROM candidates c LEFT JOIN meta m USING (stream_id)
             LEFT JOIN files f ON f.path = m.original_path
             LEFT JOIN tracked t ON t.path = m.original_path""",
}

# Which other logical tables each one reads.
_READS = {
    "parts": ["uploads"],
    "good_attempts": ["attempts"],
    "part_outcomes": ["good_attempts"],
    "pieces": ["packed"],
    "typed": ["pieces"],
    "seen": ["raw"],
    "classified": ["seen"],
    "generations": ["feed"],
    "routed": ["feed"],
    "reasons": ["ops"],
    "candidates": ["uploads", "meta"],
    "document_rows": ["meta", "parts"],
    "bursts": ["raw"],
    "burst_bounds": ["bursts"],
    "looked_up": ["meta", "files", "tracked"],
    "resumed": ["candidates", "meta", "files", "tracked"],
}


def _with(names: str, select: str) -> str:
    ordered: list[str] = []

    def add(name: str) -> None:
        for below in _READS.get(name, []):
            add(below)
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        add(name)
    if not ordered:
        return select
    return "WITH " + ",\n".join(f"{n} AS ({_TABLES[n]})" for n in ordered) + "\n" + select


_PART_TEXT = f"{_text('uploaded_at')} AS uploaded_at"

_LATEST = _with("parts", f"SELECT stream_id, part_number, etag, size_bytes, {_PART_TEXT} FROM parts")

_TOTALS = _with(
    "parts",
    """SELECT stream_id, count(*) AS parts, CAST(sum(size_bytes) AS BIGINT) AS total_size_bytes,
              max(part_number) AS max_part FROM parts GROUP BY stream_id""",
)


_FILE_CHUNK = 16 * 1024
_MEDIA = """
    WITH media AS (
      SELECT coalesce(source, 'none') || '-' || (doc_id // 1000) || '-f.mp4' AS file_name,
             hex(encode(string_agg(text, '' ORDER BY doc_id))) AS h
      FROM documents WHERE text IS NOT NULL GROUP BY 1),
    sized AS (SELECT *, CAST(length(h) // 2 AS BIGINT) AS n FROM media)"""


def _file_parts(spans: str, columns: str) -> str:
    """Tagged ranges of the bytes from ``start`` to ``stop`` in ``h``, numbered from ``first``."""
    c = _FILE_CHUNK
    return f"""{_MEDIA}, spans AS ({spans}),
        parts AS (SELECT *, unnest(range((stop - start + {c} - 1) // {c})) AS k FROM spans),
        cut AS (SELECT *, start + k * {c} AS "offset", least({c}, stop - start - k * {c}) AS length FROM parts)
        SELECT file_name, {columns} CAST(first + k AS INTEGER) AS part_number, "offset", length,
               'ok' AS status, md5(unhex(substr(h, "offset" * 2 + 1, length * 2))) AS etag
        FROM cut"""


def _classified() -> str:
    return _with(
        "classified",
        f"SELECT seq, {_text('ts')} AS ts, path, generation, step, event FROM classified",
    )


def _stale(truncated: str) -> str:
    cut = (
        "WHEN coalesce(total_bytes_sent, 0) > file_size THEN 'fail:stale_truncated'"
        if truncated == "fail"
        else ""
    )
    return _with(
        "looked_up",
        f"""SELECT stream_id, status, split_part(d, ':', 1) AS action,
                   nullif(split_part(d, ':', 2), '') AS reason,
                   d = 'fail:stale_file_missing' AND tracked_id IS NOT NULL AS abort_upload
            FROM (SELECT *, CASE
                WHEN status <> 'active' THEN 'skip'
                WHEN last_activity_at IS NULL THEN 'touch'
                WHEN age <= 30 THEN 'fresh'
                WHEN original_path IS NULL THEN 'fail:stale_no_path'
                WHEN file_size IS NULL THEN 'fail:stale_file_missing'
                {cut}
                WHEN coalesce(total_bytes_sent, 0) >= file_size THEN
                    CASE WHEN tracked_id = stream_id THEN 'finalize'
                         WHEN tracked_id IS NOT NULL THEN 'fail:stale_processor_mismatch'
                         ELSE 'resume_finalize' END
                WHEN tracked_id = stream_id THEN 'reprocess'
                ELSE 'resume_write' END AS d FROM looked_up)""",
    )


def _resume(compat: bool) -> str:
    by_reason = (
        ""
        if compat
        else """WHEN status LIKE 'failed!_%' ESCAPE '!' AND failure_reason IN
                     ('failed_meta_upload', 'failed_meta_generation') THEN 'finalize'"""
    )
    return _with(
        "resumed",
        f"""SELECT stream_id, status,
                CASE WHEN no_meta OR incomplete THEN 'fail'
                     WHEN tracked_id IS NOT NULL THEN 'skip'
                     WHEN file_size IS NULL THEN 'fail'
                     WHEN coalesce(status, 'unknown') IN ('pending_completion', 's3_completed',
                          'failed_meta_upload', 'failed_meta_generation') THEN 'finalize'
                     {by_reason}
                     WHEN coalesce(status, 'unknown') IN ('active', 'processing',
                          'interrupted_shutdown_write', 'interrupted_cancelled_write', 'unknown')
                     THEN 'write' ELSE 'none' END AS action,
                CASE WHEN no_meta THEN 'resume_no_meta'
                     WHEN incomplete THEN 'resume_incomplete_meta'
                     WHEN tracked_id IS NOT NULL THEN NULL
                     WHEN file_size IS NULL THEN 'file_missing_on_resume' END AS reason
            FROM resumed""",
    )


def _positions(offset: str) -> str:
    return _with(
        "parts meta",
        f"""SELECT m.stream_id, CAST(coalesce(m.total_bytes_sent, {offset}) AS BIGINT) AS resume_offset,
                   CAST(coalesce(m.next_part_to_upload, t.max_part + 1, 1) AS INTEGER) AS next_part,
                   CAST(coalesce(t.n, 0) AS BIGINT) AS known_parts
            FROM meta m LEFT JOIN (SELECT stream_id, count(*) AS n, sum(size_bytes) AS total,
                                          max(part_number) AS max_part
                                   FROM parts GROUP BY stream_id) t USING (stream_id)""",
    )


def _histogram(source: str, label: str, bounds: list[int]) -> str:
    group = f"{label}, " if label else ""
    rows = " UNION ALL ".join(
        [f"SELECT '{b}' AS le, CAST({b} AS DOUBLE) AS bound" for b in bounds]
        + ["SELECT '+Inf', CAST('infinity' AS DOUBLE)"]
    )
    return f"""SELECT {group}le, count(*) FILTER (v <= bound) AS bucket_count,
                      count(*) AS observations,
                      CAST(CAST(sum(v) AS DECIMAL(28,2)) AS VARCHAR) AS observed_sum
               FROM ({source}) s CROSS JOIN ({rows}) b WHERE v IS NOT NULL GROUP BY {group}le"""


def _membership() -> str:
    """Each set's last add or remove; no change at all leaves a stream outside."""
    change = {
        "active": """CASE WHEN status = 'active' THEN 1
            WHEN status IN ('pending_completion', 'completed_with_meta')
                 OR starts_with(status, 'failed_') THEN 0 END""",
        "pending_completion": """CASE WHEN status = 'pending_completion' THEN 1
            WHEN status IN ('completed_with_meta', 'interrupted_cancelled_finalize',
                            'aborted_no_parts') OR starts_with(status, 'failed_') THEN 0 END""",
        "failed": "CASE WHEN starts_with(status, 'failed_') THEN 1 END",
        "completed": "CASE WHEN status = 'completed_with_meta' THEN 1 END",
    }
    moves = " UNION ALL ".join(
        f"SELECT stream_id, ts, seq, '{name}' AS member_of, {case} AS inside FROM log"
        for name, case in change.items()
    )
    flags = ", ".join(
        f"""coalesce(max(inside) FILTER (member_of = '{name}'), 0) = 1 AS in_{name}"""
        for name in change
    )
    listed = ", ".join(f"CASE WHEN in_{name} THEN '{name}' END" for name in change)
    return _with(
        "log",
        f"""SELECT *, coalesce(nullif(concat_ws(',', {listed}), ''), 'none') AS sets
            FROM (SELECT stream_id, {flags} FROM (
                SELECT * FROM ({moves}) WHERE inside IS NOT NULL
                QUALIFY row_number() OVER (PARTITION BY stream_id, member_of
                                           ORDER BY ts DESC, seq DESC) = 1)
                GROUP BY stream_id)""",
    )


COMPLETED = """
    SELECT stream_id,
           (epoch_us(max(ts) FILTER (WHERE status = 'completed_with_meta')) - epoch_us(min(ts)))
               / 1000000.0 AS seconds
    FROM log GROUP BY stream_id
    HAVING arg_max(status, struct_pack(t := ts, s := seq)) = 'completed_with_meta'"""


def all_sql() -> dict[str, str]:
    feed_columns = f"seq, {_text('ts')} AS ts, path, event"
    doc_chunk = "substr(data_hex, CAST(\"offset\" * 2 + 1 AS BIGINT), length * 2)"
    return {
        "file_inventory": f"{_MEDIA} SELECT file_name, n AS size FROM sized",
        "read_chunks": _file_parts(
            "SELECT file_name, h, CAST(0 AS BIGINT) AS start, n AS stop, 1 AS first FROM sized", ""
        ),
        "tail_chunks": _file_parts(
            f"""SELECT file_name, CAST(1 AS BIGINT) AS generation, h, CAST(0 AS BIGINT) AS start,
                       n // 2 AS stop, CAST(1 AS BIGINT) AS first FROM sized
                UNION ALL SELECT file_name, 1, h, n // 2, n, 1 + (n // 2 + {_FILE_CHUNK} - 1) // {_FILE_CHUNK}
                FROM sized
                UNION ALL SELECT file_name, 3, right(h, CAST(n // 4 * 2 AS BIGINT)), 0, n // 4, 1
                FROM sized WHERE n % 2 = 1""",
            "generation,",
        ),
        "change_feed": _with("raw", f"SELECT seq, {_text('ts')} AS ts, path, kind FROM raw"),
        "snapshot_diff": """
            WITH old AS (SELECT l_orderkey AS k, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS size,
                                max(l_shipdate) AS at FROM lineitem
                         WHERE l_shipdate < TIMESTAMP '1998-06-01' GROUP BY l_orderkey),
                 new AS (SELECT l_orderkey AS k, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS size,
                                max(l_shipdate) AS at FROM lineitem
                         WHERE l_linestatus = 'O' GROUP BY l_orderkey)
            SELECT '/watch/' || coalesce(old.k, new.k) || '.mp4' AS path,
                   CASE WHEN old.k IS NULL THEN 'added' WHEN new.k IS NULL THEN 'deleted'
                        ELSE 'modified' END AS kind,
                   old.size AS old_size, new.size AS new_size
            FROM old FULL JOIN new ON old.k = new.k
            WHERE old.k IS NULL OR new.k IS NULL OR old.size <> new.size OR old.at <> new.at""",
        "write_ledger": _LATEST,
        "write_metadata_json": _with(
            "document_rows",
            """SELECT stream_id, count(part_number) AS chunk_count,
                      CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS total_size_bytes,
                      max(etag) AS last_etag
               FROM document_rows GROUP BY stream_id""",
        ),
        "assemble_objects": _with(
            "doc_chunks",
            """SELECT stream_id, CAST("offset" // 16384 AS BIGINT) AS segment,
                      min("offset") AS "offset", CAST(sum(length) AS BIGINT) AS length,
                      count(*) AS chunk_count,
                      md5(unhex(substr(any_value(data_hex), CAST(min("offset") * 2 + 1 AS BIGINT),
                                       CAST(sum(length) * 2 AS BIGINT)))) AS data_md5
               FROM doc_chunks GROUP BY stream_id, "offset" // 16384""",
        ),
        "filter_suffix": "SELECT page_id, url FROM pages WHERE right(url, 4) = '#top'",
        "valid_parts": _with(
            "attempts",
            f"""SELECT stream_id, part_number, etag, size_bytes, {_PART_TEXT}
                FROM attempts WHERE etag IS NOT NULL AND etag <> ''""",
        ),
        "completion_manifest": _with(
            "good_attempts",
            """SELECT stream_id, CAST(0 AS BIGINT) AS page, count(*) AS part_count,
                      string_agg(part_number || ':' || etag, ',' ORDER BY part_number) AS parts
               FROM good_attempts GROUP BY stream_id""",
        ),
        "list_parts": _with(
            "attempts",
            """SELECT stream_id, part_number, etag, size_bytes FROM attempts
               WHERE part_number IS NOT NULL AND etag IS NOT NULL AND size_bytes IS NOT NULL""",
        ),
        "object_keys": _with(
            "meta",
            """SELECT stream_id, original_path,
                      'streams/' || stream_id || '/' || regexp_extract(original_path, '[^/]*$')
                          AS object_key,
                      'streams/' || stream_id || '/' || regexp_extract(original_path, '[^/]*$')
                          || '.metadata.json' AS metadata_key FROM meta""",
        ),
        "assign_stream_ids": _with(
            "classified",
            """SELECT seq, path, generation, md5(path || '#' || generation) AS stream_id
               FROM classified WHERE event = 'CREATE'""",
        ),
        "init_stream_meta": _with(
            "classified",
            f"""SELECT id AS stream_id, path AS original_path, id AS s3_upload_id,
                       'media' AS s3_bucket,
                       'streams/' || id || '/' || regexp_extract(path, '[^/]*$') AS s3_key_prefix,
                       'active' AS status, {_text('ts')} AS started_at,
                       {_text('ts')} AS last_activity_at,
                       CAST(NULL AS BIGINT) AS total_bytes_expected,
                       CAST(0 AS BIGINT) AS total_bytes_sent, 1 AS next_part_to_upload,
                       CAST(NULL AS VARCHAR) AS failure_reason
                FROM (SELECT *, md5(path || '#' || generation) AS id FROM classified
                      WHERE event = 'CREATE')""",
        ),
        "plan_chunks": _with(
            "doc_chunks",
            """SELECT stream_id, CAST(size AS BIGINT) AS size, part_number, "offset", length
               FROM doc_chunks""",
        ),
        "latest_parts": _LATEST,
        "parse_part_records": _with(
            "typed",
            f"""SELECT stream_id, part_key, packed,
                    CASE WHEN reject_reason IS NULL THEN part_number END AS part_number,
                    CASE WHEN reject_reason IS NULL THEN size_bytes END AS size_bytes,
                    CASE WHEN reject_reason IS NULL THEN {_text('uploaded_at')} END AS uploaded_at,
                    reject_reason FROM typed""",
        ),
        "chunk_checksums": _with(
            "doc_chunks",
            f"""SELECT stream_id, part_number, "offset", length, md5(unhex({doc_chunk})) AS etag
                FROM doc_chunks""",
        ),
        "upload_progress": _with(
            "part_outcomes",
            f"""SELECT stream_id, part_number, CAST(sent AS BIGINT) AS bytes_sent,
                       part_number + 1 AS next_part, {_text('latest')} AS last_activity_at
                FROM (SELECT *, sum(size_bytes) OVER w AS sent, max(uploaded_at) OVER w AS latest,
                             sum(CASE WHEN etag IS NULL THEN 1 ELSE 0 END) OVER w AS failures
                      FROM part_outcomes
                      WINDOW w AS (PARTITION BY stream_id ORDER BY part_number))
                WHERE failures = 0""",
        ),
        "stream_totals": _TOTALS,
        "resume_positions": _positions("0"),
        "resume_positions_from_parts": _positions("t.total, 0"),
        "audit_ledger": _with(
            "uploads parts meta files",
            """SELECT m.stream_id, CAST(coalesce(u.n, 0) AS BIGINT) AS uploads,
                      CAST(coalesce(p.n, 0) AS BIGINT) AS distinct_parts,
                      CAST(coalesce(u.n - p.n, 0) AS BIGINT) AS repeats,
                      CAST(coalesce(p.top - p.n, 0) AS BIGINT) AS missing_parts,
                      CAST((SELECT min(g) FROM range(1, 100) r(g)
                            WHERE g < p.top AND NOT list_contains(p.numbers, g)) AS INTEGER) AS first_gap,
                      CAST(coalesce(p.bytes, 0) AS BIGINT) AS ledger_bytes,
                      f.size AS file_bytes,
                      coalesce(p.bytes, 0) IS DISTINCT FROM f.size AS size_mismatch,
                      coalesce(p.bytes, 0) IS DISTINCT FROM coalesce(m.total_bytes_sent, 0)
                          AS counter_mismatch
               FROM meta m
               LEFT JOIN (SELECT stream_id, count(*) AS n FROM uploads GROUP BY stream_id) u
                    USING (stream_id)
               LEFT JOIN (SELECT stream_id, count(*) AS n, max(part_number) AS top,
                                 sum(size_bytes) AS bytes,
                                 list(CAST(part_number AS BIGINT)) AS numbers
                          FROM parts GROUP BY stream_id) p USING (stream_id)
               LEFT JOIN files f ON f.path = m.original_path""",
        ),
        "classify_changes": _classified(),
        "classify_stream": _classified(),
        "stream_generations": _with(
            "generations", f"SELECT {feed_columns}, generation FROM generations"
        ),
        "route_events": _with("routed", f"SELECT {feed_columns}, action FROM routed"),
        "route_events_tracked": _with(
            "feed open_paths",
            f"""SELECT path, {_text('ts')} AS ts, seq, event, stream_id,
                       CASE event WHEN 'CREATE' THEN if(stream_id IS NULL, 'open', 'ignore')
                            WHEN 'WRITE' THEN if(stream_id IS NULL, 'reopen', 'process')
                            ELSE if(stream_id IS NULL, 'none', 'close') END AS action
                FROM feed LEFT JOIN open_paths USING (path)""",
        ),
        "dedupe_creates": _with(
            "generations",
            f"""SELECT {feed_columns}, generation FROM (
                    SELECT *, row_number() OVER (PARTITION BY path, generation, event
                                                 ORDER BY ts, seq) AS n FROM generations)
                WHERE event <> 'CREATE' OR n = 1""",
        ),
        "untracked_events": _with(
            "feed open_paths",
            f"""SELECT {feed_columns} FROM feed
                WHERE event <> 'CREATE' AND path NOT IN (SELECT path FROM open_paths)""",
        ),
        "closed_streams": _with(
            "feed open_paths",
            f"""SELECT stream_id, path, {_text('ts')} AS ts, seq, 'deleted_locally' AS status
                FROM feed JOIN open_paths USING (path) WHERE event = 'DELETE'
                QUALIFY row_number() OVER (PARTITION BY path ORDER BY feed.ts, seq) = 1""",
        ),
        "latest_state": _with(
            "log",
            f"""SELECT a.stream_id, a.status, b.failure_reason, {_text('a.ts')} AS last_activity_at
                FROM (SELECT * FROM log QUALIFY row_number() OVER
                          (PARTITION BY stream_id ORDER BY ts DESC, seq DESC) = 1) a
                LEFT JOIN (SELECT * FROM log WHERE failure_reason IS NOT NULL
                           QUALIFY row_number() OVER
                               (PARTITION BY stream_id ORDER BY ts DESC, seq DESC) = 1) b
                     USING (stream_id)""",
        ),
        "membership": _membership(),
        "streams_by_status": _with(
            "meta",
            """SELECT stream_id, status FROM meta
               WHERE status = 'active' OR status = 'pending_completion'""",
        ),
        "failure_records": _with(
            "reasons",
            f"""SELECT stream_id, {_text('ts')} AS ts, seq, 'failed_' || failure_reason AS status,
                       failure_reason FROM reasons WHERE failure_reason IS NOT NULL""",
        ),
        "failure_reason": _with(
            "reasons", "SELECT seq, operation, error_class, failure_reason FROM reasons"
        ),
        "first_and_last_failure": _with(
            "reasons",
            """SELECT stream_id, arg_min(failure_reason, (ts, seq)) AS first_reason,
                      arg_max(failure_reason, (ts, seq)) AS last_reason, count(*) AS failures
               FROM reasons WHERE failure_reason IS NOT NULL GROUP BY stream_id""",
        ),
        "purge_completed": _with(
            "meta uploads",
            """SELECT 'state' AS kind, stream_id, 0 AS part_number FROM meta
               WHERE status <> 's3_completed'
               UNION ALL
               SELECT 'ledger', stream_id, part_number FROM uploads WHERE stream_id NOT IN
                   (SELECT stream_id FROM meta WHERE status = 's3_completed')""",
        ),
        "stale_streams": _with(
            "looked_up",
            """SELECT stream_id, CAST(age AS BIGINT) AS idle_seconds FROM looked_up
               WHERE status = 'active' AND age > 30""",
        ),
        "stale_actions": _stale("finalize"),
        "stale_actions_truncated": _stale("fail"),
        "resume_candidates": _with("candidates", "SELECT stream_id FROM candidates"),
        "resume_actions": _resume(False),
        "resume_actions_compat": _resume(True),
        "finalize_plan": _with(
            "meta good_attempts",
            """SELECT stream_id, s3_key_prefix, parts,
                      CASE WHEN missing THEN 'fail' WHEN parts = 0 THEN 'abort_no_parts'
                           ELSE 'complete' END AS action,
                      CASE WHEN missing THEN 'finalize_file_missing' END AS reason
               FROM (SELECT m.stream_id, m.s3_key_prefix,
                            (SELECT count(*) FROM good_attempts a
                             WHERE a.stream_id = m.stream_id) AS parts,
                            m.original_path IS NULL OR m.original_path NOT IN
                                (SELECT '/watch/' || l_orderkey || '.mp4' FROM lineitem
                                 WHERE l_shipdate < TIMESTAMP '1998-06-01') AS missing
                     FROM meta m)""",
        ),
        "metadata_documents": _with(
            "document_rows durations",
            f"""SELECT stream_id, CAST(0 AS BIGINT) AS page, original_file_path, s3_bucket,
                       s3_key_prefix, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS total_size_bytes,
                       count(part_number) AS total_chunks, count(part_number) AS chunk_count,
                       any_value(d.duration_seconds) AS duration_seconds,
                       '2002-01-01 00:00:00.000000' AS processed_at,
                       {_text('started_at')} AS stream_started_at,
                       {_text('last_activity_at')} AS stream_completed_at,
                       coalesce(string_agg(part_number || ':' || size_bytes || ':' || etag, ','
                                           ORDER BY part_number), '') AS chunks
                FROM document_rows r LEFT JOIN durations d ON d.path = r.original_file_path
                GROUP BY ALL""",
        ),
        "flatten_chunks": _with(
            "document_rows",
            f"SELECT stream_id, part_number, size_bytes, etag, {_PART_TEXT} FROM document_rows",
        ),
        "probe_results": """
            SELECT '/watch/e' || event_id || '.mp4' AS path,
                   CASE WHEN event_type IN ('signup', 'purchase')
                        THEN CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR) END AS duration_seconds,
                   CASE event_type
                        WHEN 'error' THEN 'ffprobe error (return code 1): no such file'
                        WHEN 'view' THEN 'ffprobe error (return code 0): '
                        WHEN 'click' THEN 'ffprobe output is not a valid float: N/A' END AS error
            FROM events""",
        "activity_sessions": _with(
            "burst_bounds",
            f"""SELECT path, session_no, {_text('session_start')} AS session_start,
                       {_text('session_end')} AS session_end, events FROM burst_bounds""",
        ),
        "idle_events": _with(
            "burst_bounds",
            f"""SELECT path, 'IDLE' AS event, {_text('session_start')} AS session_start,
                       {_text('session_end')} AS idle_at, events FROM burst_bounds""",
        ),
        "progress_stream": _with(
            "uploads",
            """SELECT stream_id, count(*) AS parts, CAST(sum(size_bytes) AS BIGINT) AS total_size_bytes,
                      max(part_number) AS max_part FROM uploads GROUP BY stream_id""",
        ),
        "chunk_counters": _with(
            "uploads",
            """SELECT stream_id, count(*) AS chunks_uploaded,
                      CAST(sum(size_bytes) AS BIGINT) AS bytes_uploaded
               FROM uploads GROUP BY stream_id""",
        ),
        "failed_operations": _with(
            "reasons",
            """SELECT stream_id, operation_type, count(*) AS failed_operations FROM (
                   SELECT stream_id, failure_reason AS operation_type FROM reasons
                   WHERE failure_reason IS NOT NULL AND (operation IN ('write', 'finalize')
                         OR operation = 'init_checkpoint' AND error_class <> 'FileNotFoundError')
                   UNION ALL
                   SELECT stream_id, 'redis_set_failed_' || failure_reason FROM reasons
                   WHERE failure_reason IS NOT NULL
                   UNION ALL
                   SELECT stream_id, 'process_file_disappeared' FROM reasons
                   WHERE operation = 'write' AND error_class = 'FileNotFoundError'
                   UNION ALL
                   SELECT stream_id, 's3_upload_part' FROM reasons WHERE operation = 'upload_part')
               GROUP BY stream_id, operation_type""",
        ),
        "stream_outcomes": _with(
            "log",
            """SELECT count(DISTINCT stream_id) FILTER (status = 'completed_with_meta')
                          AS streams_completed,
                      count(DISTINCT stream_id) FILTER (starts_with(status, 'failed_'))
                          AS streams_failed FROM log""",
        ),
        "active_gauge": _with(
            "routed",
            f"""SELECT seq, {_text('ts')} AS ts, path, delta,
                       CAST(sum(delta) OVER (ORDER BY routed.ts, seq) AS BIGINT) AS active_streams
                FROM (SELECT *, CASE WHEN action = 'close' THEN -1 ELSE 1 END AS delta FROM routed
                      WHERE action IN ('open', 'reopen', 'close')) AS routed""",
        ),
        "duration_histogram": _histogram(
            "SELECT event_type AS label, CAST(value AS DECIMAL(18,2)) AS v FROM events",
            "label",
            [5, 10, 30, 60, 120, 300, 600, 1800, 3600],
        ),
        "processing_time": _with("log", f"SELECT stream_id, CAST(floor(seconds) AS BIGINT) AS processing_seconds FROM ({COMPLETED})"),
        "processing_time_histogram": _with(
            "log",
            _histogram(
                f"SELECT CAST(seconds AS DECIMAL(18,2)) AS v FROM ({COMPLETED})",
                "",
                [10, 30, 60, 120, 300, 600, 1800, 3600, 7200],
            ),
        ),
    }
