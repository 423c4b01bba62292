"""Fragments of checking SQL used by several queries."""


def area(p: str) -> str:
    return f"(({p}.x2 - {p}.x1) * ({p}.y2 - {p}.y1))"


def px(p: str) -> str:
    return f"sqrt({area(p)})"


def inter(p: str, q: str) -> str:
    return (f"(greatest(least({p}.x2, {q}.x2) - greatest({p}.x1, {q}.x1), 0.0) * "
            f"greatest(least({p}.y2, {q}.y2) - greatest({p}.y1, {q}.y1), 0.0))")


def iou(p: str, q: str) -> str:
    return f"({inter(p, q)} / ({area(p)} + {area(q)} - {inter(p, q)}))"


def bucket(expr: str) -> str:
    return (f"CASE WHEN {expr} < 8 THEN '<8px' WHEN {expr} < 16 THEN '8-16px' "
            f"WHEN {expr} < 32 THEN '16-32px' ELSE '>32px' END")


# Greedy matching of one frame as a list fold: dets in score order, each entry carries its
# candidates best first; the accumulator is the list of outcomes so far.
def greedy_cells(cells: list[tuple[str, float, float, float]]) -> str:
    """CTEs ``cells``, ``cand``, ``outcome`` giving (cell, frame, det_index, score, kind, gt_index).

    Written as a recursion over the detections of a frame in score order.
    """
    values = ", ".join(f"({i}, '{b}', CAST({t} AS DOUBLE), CAST({lo} AS DOUBLE), CAST('{hi}' AS DOUBLE))"
                       for i, (b, t, lo, hi) in enumerate(cells))
    return f"""
    cells(cell, bucket, thr, lo, hi) AS (VALUES {values}),
    pairs AS (
      SELECT d.source_video, d.frame_index, d.det_index, d.score, g.gt_index,
             {iou('d', 'g')} AS iou, {px('g')} AS gpx
      FROM fx_detections d JOIN fx_ground_truth g USING (source_video, frame_index)
      WHERE {iou('d', 'g')} >= (SELECT min(thr) FROM cells)
    ),
    near AS (
      SELECT source_video, frame_index, det_index, score,
             list({{'gt': gt_index, 'iou': iou, 'px': gpx}} ORDER BY iou DESC, gt_index) AS cands
      FROM pairs GROUP BY ALL
    ),
    queued AS (
      SELECT *, ROW_NUMBER() OVER (PARTITION BY source_video, frame_index ORDER BY score DESC, det_index) AS turn
      FROM near
    ),
    fold AS (
      SELECT c.cell, q.source_video, q.frame_index, CAST(0 AS BIGINT) AS turn, CAST(NULL AS BIGINT) AS det_index,
             CAST([] AS BIGINT[]) AS taken, 0 AS kind, CAST(NULL AS BIGINT) AS gt
      FROM cells c, (SELECT DISTINCT source_video, frame_index FROM queued) q
      UNION ALL
      SELECT cell, source_video, frame_index, turn, det_index,
             CASE WHEN gt IS NULL THEN taken ELSE list_append(taken, gt) END, kind, gt
      FROM (
        SELECT s.cell, s.source_video, s.frame_index, s.turn, s.det_index, s.taken,
               CASE WHEN s.inside IS NOT NULL THEN 1 WHEN s.other IS NOT NULL THEN 2 ELSE 0 END AS kind,
               coalesce(s.inside, s.other) AS gt
        FROM (
          SELECT f.cell, f.source_video, f.frame_index, q.turn, q.det_index, f.taken,
                 list_filter(q.cands, lambda x: x.iou >= c.thr AND NOT list_contains(f.taken, x.gt)
                             AND x.px >= c.lo AND x.px < c.hi)[1].gt AS inside,
                 list_filter(q.cands, lambda x: x.iou >= c.thr AND NOT list_contains(f.taken, x.gt))[1].gt AS other
          FROM fold f JOIN cells c USING (cell)
          JOIN queued q ON q.source_video = f.source_video AND q.frame_index = f.frame_index AND q.turn = f.turn + 1
        ) s
      )
    ),
    outcome AS (
      SELECT c.cell, c.bucket, c.thr, d.source_video, d.frame_index, d.det_index, d.score,
             coalesce(f.kind, 0) AS kind, f.gt AS gt_index
      FROM cells c CROSS JOIN fx_detections d
      LEFT JOIN (SELECT * FROM fold WHERE turn > 0) f
        ON f.cell = c.cell AND f.source_video = d.source_video AND f.frame_index = d.frame_index
       AND f.det_index = d.det_index
    )"""


ELIGIBLE = f"""eligible AS (
      SELECT c.cell, (SELECT count(*) FROM fx_ground_truth g WHERE {px('g')} >= c.lo AND {px('g')} < c.hi) AS n_eligible
      FROM cells c)"""

AP = """ranked AS (
      SELECT cell, kind,
             sum(CASE WHEN kind = 1 THEN 1 ELSE 0 END) OVER w AS tp, count(*) OVER w AS n,
             row_number() OVER w AS pos
      FROM outcome WHERE kind <> 2
      WINDOW w AS (PARTITION BY cell ORDER BY score DESC, source_video, frame_index, det_index ROWS UNBOUNDED PRECEDING)
    ),
    envelope AS (
      SELECT cell, kind, max(CAST(tp AS DOUBLE) / n) OVER (PARTITION BY cell ORDER BY pos
             ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS best FROM ranked
    ),
    ap AS (SELECT cell, sum(best) AS area FROM envelope WHERE kind = 1 GROUP BY cell)"""
