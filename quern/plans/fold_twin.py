"""The projection in the twins' SQL, written apart from the Spark fold: a recursion over each file's events.

A step of the recursion takes the n-th event of every file. ``p`` adds the row that the event gives birth to,
``g`` whether the event is stale, and the outermost select what becomes of each column. Every step stays
in ``st`` with what it counted (plus_in, minus_in: the directory), so counts follow from it as well.
"""

from __future__ import annotations


def normal(p: str) -> str:
    return f"""CASE WHEN trim(coalesce({p}, '')) = '' THEN '/' ELSE '/' || array_to_string(list_reduce(list_filter(string_split(replace({p}, '\\', '/'), '/'), lambda x: x <> '' AND x <> '.'),
        lambda a, x: CASE WHEN x = '..' THEN a[:-2] ELSE list_append(a, x) END, []::VARCHAR[]), '/') END"""


def steps(events: str = "SELECT * FROM journal", copies: int = 1) -> str:
    """``WITH RECURSIVE`` up to ``st`` (all steps) and ``final`` (files after their last event)."""
    repeat = f"unnest(range({copies}))"
    return f"""WITH RECURSIVE ev AS (
        SELECT tenant_id AS t, file_key AS k, event_type AS ty, occurred_at AS happened, coalesce(processing_start_time, occurred_at) AS lease, processing_start_time AS own_lease, volume_id AS vol, physical_path AS path,
          {normal("directory_path")} AS dir, file_size AS size, status AS st, retry_count AS retry, available_at AS avail, error_message AS err, physical_present AS here, sequence_number AS seq,
          row_number() OVER (PARTITION BY tenant_id, file_key ORDER BY sequence_number, copy) AS n
        FROM (SELECT *, {repeat} AS copy FROM ({events}))),
      st AS (
        SELECT DISTINCT t, k, 0::BIGINT AS n, 0::BIGINT AS seq, FALSE AS alive, NULL::INT AS status, NULL::TIMESTAMP AS processing_start_time, NULL::TIMESTAMP AS available_at, NULL::INT AS retry_count,
          NULL::TIMESTAMP AS last_failed_at, NULL::TIMESTAMP AS completed_at, NULL::TIMESTAMP AS dead_lettered_at, NULL::VARCHAR AS last_error, NULL::VARCHAR AS physical_path, NULL::VARCHAR AS volume_id,
          NULL::VARCHAR AS directory_path, NULL::BIGINT AS file_size, NULL::TIMESTAMP AS created_at, NULL::TIMESTAMP AS released_lease, NULL::TIMESTAMP AS delete_succeeded_at, FALSE AS accepted_applied, FALSE AS dead_letter_applied,
          NULL::VARCHAR AS plus_in, NULL::VARCHAR AS minus_in, NULL::BIGINT AS waits_at
        FROM ev
        UNION ALL
        SELECT t, k, n, seq, there AND ty <> 6 AS alive,
          -- status
          CASE WHEN skip THEN status WHEN ty = 2 THEN 1 WHEN ty = 3 THEN coalesce(e_st, 0) WHEN ty = 4 THEN 2 WHEN ty = 5 THEN 5 WHEN ty = 7 THEN 0 WHEN ty = 8 THEN 7 ELSE status END,
          CASE WHEN skip OR ty = 1 THEN pst WHEN ty = 2 THEN lease END,
          CASE WHEN skip OR ty = 1 THEN av WHEN ty = 3 AND coalesce(e_st, 0) = 0 THEN avail WHEN ty = 7 THEN coalesce(avail, happened) END,
          CASE WHEN NOT skip AND ty = 3 THEN coalesce(retry, rc) ELSE rc END,
          CASE WHEN NOT skip AND ty = 3 THEN happened ELSE lf END,
          CASE WHEN skip OR ty = 1 THEN ca WHEN ty = 4 THEN happened WHEN ty = 5 THEN coalesce(ca, happened) END,
          CASE WHEN skip OR ty = 1 THEN dl WHEN ty = 8 THEN happened END,
          CASE WHEN skip THEN le WHEN ty = 2 THEN coalesce(err, le) WHEN ty = 3 THEN err WHEN ty IN (4, 5) THEN NULL ELSE le END,
          CASE WHEN NOT skip AND ty = 8 THEN coalesce(e_path, pp) ELSE pp END,
          CASE WHEN NOT skip AND ty = 8 THEN coalesce(e_vol, vo) ELSE vo END,
          di, fs, cr,
          CASE WHEN skip THEN rl WHEN ty = 2 THEN NULL WHEN ty IN (3, 7) THEN coalesce(own_lease, rl) WHEN ty = 4 THEN own_lease ELSE rl END,
          CASE WHEN skip OR ty = 1 THEN ds END,
          aa, CASE WHEN skip OR ty = 1 THEN da ELSE ty = 8 END,
          CASE WHEN born OR counts THEN di END, CASE WHEN there AND (ty = 6 OR (ty = 8 AND NOT skip)) THEN di END,
          coalesce(waits_at, CASE WHEN asked AND here IS NULL THEN seq END)
        FROM (
          SELECT *, NOT there OR CASE
              WHEN ty = 2 THEN coalesce(pst >= lease, FALSE) OR coalesce(lf >= lease, FALSE) OR coalesce(ca >= lease, FALSE)
              WHEN ty IN (3, 4) THEN coalesce(pst > lease, FALSE) OR coalesce(lf >= happened, FALSE) OR coalesce(ca >= happened, FALSE)
              WHEN ty = 7 THEN status <> 1 OR pst IS NULL OR pst > lease OR coalesce(lf >= happened, FALSE) OR coalesce(ca >= happened, FALSE)
              WHEN ty = 5 THEN born OR (status = 5 AND ca IS NOT NULL AND pst IS NULL AND av IS NULL AND coalesce(le, '') = '')
              WHEN ty = 8 THEN da AND status = 7 AND coalesce(dl >= happened, FALSE)
              ELSE FALSE END AS skip
          FROM (
            SELECT e.t, e.k, e.n, e.seq, e.ty, e.happened, e.lease, e.own_lease, e.st AS e_st, e.retry, e.avail, e.err, e.path AS e_path, e.vol AS e_vol, e.here, s.waits_at,
              NOT s.alive AND e.ty <> 6 AND trim(coalesce(e.path, '')) <> '' AS asked,
              asked AND coalesce(e.here, FALSE) AS born, s.alive OR born AS there, s.alive AND e.ty = 1 AND NOT s.accepted_applied AS counts,
              CASE WHEN born THEN coalesce(e.st, CASE WHEN e.ty = 2 THEN 1 WHEN e.ty = 4 THEN 2 WHEN e.ty = 5 THEN 5 WHEN e.ty = 8 THEN 7 ELSE 0 END) ELSE s.status END AS status,
              CASE WHEN born THEN e.own_lease ELSE s.processing_start_time END AS pst, CASE WHEN born THEN e.avail ELSE s.available_at END AS av, CASE WHEN born THEN coalesce(e.retry, 0) ELSE s.retry_count END AS rc,
              CASE WHEN NOT born THEN s.last_failed_at WHEN e.ty = 3 THEN e.happened END AS lf,
              CASE WHEN NOT born THEN s.completed_at WHEN e.ty IN (4, 5) OR e.st IN (2, 5, 6) THEN e.happened END AS ca,
              CASE WHEN NOT born THEN s.dead_lettered_at WHEN e.ty = 8 OR e.st = 7 THEN e.happened END AS dl,
              CASE WHEN NOT born THEN s.delete_succeeded_at WHEN e.st = 6 THEN e.happened END AS ds,
              CASE WHEN born THEN e.err ELSE s.last_error END AS le, CASE WHEN born THEN e.path ELSE s.physical_path END AS pp, CASE WHEN born THEN coalesce(e.vol, '') ELSE s.volume_id END AS vo,
              CASE WHEN born THEN e.dir ELSE s.directory_path END AS di, CASE WHEN born THEN coalesce(e.size, 0) ELSE s.file_size END AS fs, CASE WHEN born THEN e.happened ELSE s.created_at END AS cr,
              CASE WHEN born THEN NULL ELSE s.released_lease END AS rl, born OR counts OR s.accepted_applied AS aa, NOT born AND s.dead_letter_applied AS da
            FROM st s JOIN ev e ON e.t = s.t AND e.k = s.k AND e.n = s.n + 1) p) g),
      final AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY t, k ORDER BY n DESC) = 1)"""
