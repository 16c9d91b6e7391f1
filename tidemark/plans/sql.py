"""The queries' meaning in DuckDB's SQL, over the same tables: common table expressions put together by name."""

from __future__ import annotations

UNIT = {"days": ("floor", 86_400_000_000), "hours": ("ceil", 3_600_000_000), "minutes": ("ceil", 60_000_000)}


def _log(clock: str) -> str:
    return f"""SELECT user_id AS case_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS pos, event_type AS act,
  'R' || CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 8 AS VARCHAR) AS res, epoch_us({clock}) AS us, value FROM events"""


def number(us: str, unit: str = "days") -> str:
    f, n = UNIT[unit]
    return f"CAST({f}({us} / {n}.0) AS BIGINT)"


def _windowed(source: str, cols: dict[str, str]) -> str:
    made = ", ".join(f"{number(us)} - {number('lo')} AS {w}" for w, us in cols.items())
    return f"SELECT t.*, {made} FROM {source} t, bounds"


CTE: dict[str, tuple[str, tuple[str, ...]]] = {
    "log": (_log("ts"), ()),
    "coarse": (_log("date_trunc('day', ts)"), ()),
    "bounds": ("SELECT min(us) AS lo, max(us) AS hi FROM log", ("log",)),
    "steps": (
        """SELECT * FROM (SELECT case_id, pos AS pos_i, lead(pos) OVER c AS pos_j, act AS a_i, lead(act) OVER c AS a_j, res AS r_i, lead(res) OVER c AS r_j, us AS us_i, lead(us) OVER c AS us_j
  FROM log WINDOW c AS (PARTITION BY case_id ORDER BY pos)) WHERE pos_j IS NOT NULL""",
        ("log",),
    ),
    "wl": (_windowed("log", {"w": "us"}), ("log", "bounds")),
    "ws": (_windowed("steps", {"w_i": "us_i", "w_j": "us_j"}), ("steps", "bounds")),
    "open": ("SELECT case_id, pos_j, a_j, r_j, w_i, w_j, unnest(range(w_i, w_j)) AS w FROM ws WHERE w_i < w_j", ("ws",)),
    "during": ("SELECT *, unnest(range(w_i, w_j + 1)) AS w FROM ws", ("ws",)),
    "finals": ("SELECT * FROM log l WHERE NOT EXISTS (SELECT 1 FROM steps s WHERE s.case_id = l.case_id AND s.pos_i = l.pos)", ("log", "steps")),
    "tied": ("SELECT *, sum(new) OVER (PARTITION BY case_id ORDER BY pos) AS tie FROM (SELECT *, CASE WHEN lag(us) OVER (PARTITION BY case_id ORDER BY pos) <> us THEN 1 ELSE 0 END AS new FROM coarse)", ("coarse",)),
    "posteps": (
        "SELECT i.case_id, i.pos AS pos_i, j.pos AS pos_j, i.act AS a_i, j.act AS a_j, i.res AS r_i, j.res AS r_j FROM tied i JOIN tied j ON i.case_id = j.case_id AND i.tie + 1 = j.tie",
        ("tied",),
    ),
    "flows": ("SELECT case_id, list(act ORDER BY pos) AS flow FROM log GROUP BY case_id", ("log",)),
    "acts": ("SELECT act AS e, count(*) AS c FROM log GROUP BY act", ("log",)),
    "ress": ("SELECT res AS e, count(*) AS c FROM log GROUP BY res", ("log",)),
    "segs": ("SELECT a_i, a_j, count(*) AS c FROM steps GROUP BY a_i, a_j", ("steps",)),
}

_NULL = "CAST(NULL AS VARCHAR)"
_SEG = "'segment' AS comp_type, a_i AS e1, a_j AS e2"
_BACK = "w_i, w_j, r_i, r_j"
_NONE = "CAST(NULL AS BIGINT) AS w_i, CAST(NULL AS BIGINT) AS w_j, CAST(NULL AS VARCHAR) AS r_i, CAST(NULL AS VARCHAR) AS r_j"


def _inst(f: str) -> tuple[str, tuple[str, ...]]:
    act, res = f"'activity' AS comp_type, act AS e1, {_NULL} AS e2", f"'resource' AS comp_type, res AS e1, {_NULL} AS e2"
    done = lambda c: f"SELECT {c}, w AS w1, w AS w2, case_id, {_NONE}, CAST(NULL AS DOUBLE) AS wait FROM wl"
    waits = lambda comp, n: f"SELECT '{comp}' AS comp_type, {n} AS e1, {_NULL} AS e2, w AS w1, w AS w2, case_id, {_NONE}, CAST(NULL AS DOUBLE) AS wait FROM open"
    seg = lambda w1, w2, src, where="TRUE", wait="CAST(NULL AS DOUBLE)": f"SELECT {_SEG}, {w1} AS w1, {w2} AS w2, case_id, {_BACK}, {wait} AS wait FROM {src} WHERE {where}"
    until = f"CASE WHEN w = w_j THEN us_j / 1000000.0 ELSE ({number('lo')} + w + 1) * 86400.0 END - us_i / 1000000.0"
    return {
        "exec": (done(act), ("wl",)),
        "to-exec": (done(act) + " UNION ALL " + waits("activity", "a_j"), ("wl", "open")),
        "do": (done(res), ("wl",)),
        "todo": (waits("resource", "r_j"), ("open",)),
        "busy": (done(res) + " UNION ALL " + waits("resource", "r_j"), ("wl", "open")),
        "enter": (seg("w_i", "w_i", "ws"), ("ws",)),
        "exit": (seg("w_j", "w_j", "ws"), ("ws",)),
        "cross": (seg("w", "w", "during"), ("during",)),
        "wt": (seg("w", "w", "during, bounds", "TRUE", until), ("during", "bounds")),
        "handover": (seg("w_j", "w_j", "ws", "r_i <> r_j"), ("ws",)),
        "workload": (seg("w_j", "w_j", "ws", "r_i = r_j"), ("ws",)),
        "batch": (seg("w_i", "w_j", "ws", "w_i < w_j"), ("ws",)),
        "delay": (seg("w_i", "w_j", "ws", "w_i < w_j"), ("ws",)),
    }[f]


_VALUE = {"wt": "avg(wait)", "handover": "CAST(count(DISTINCT r_i) AS DOUBLE) / count(DISTINCT r_j)", "workload": "CAST(count(*) AS DOUBLE) / count(DISTINCT r_i)", "delay": "max(w2 - w1)"}


def name(f: str) -> str:
    return f.replace("-", "_")


for _f in ("exec", "to-exec", "do", "todo", "busy", "enter", "exit", "cross", "wt", "handover", "workload", "batch", "delay"):
    _text, _needs = _inst(_f)
    CTE[f"i_{name(_f)}"] = (f"SELECT '{_f}' AS f_type, * FROM ({_text})", _needs)
    CTE[f"v_{name(_f)}"] = (
        f"SELECT f_type, comp_type, e1, e2, w1, w2, round(CAST({_VALUE.get(_f, 'count(*)')} AS DOUBLE), 6) AS value, count(*) AS n, min(w_i) AS w_i_min, max(w_i) AS w_i_max, min(w_j) AS w_j_min, max(w_j) AS w_j_max FROM i_{name(_f)} GROUP BY f_type, comp_type, e1, e2, w1, w2",
        (f"i_{name(_f)}",),
    )


def union(prefix: str, features: tuple[str, ...]) -> tuple[str, tuple[str, ...]]:
    names = tuple(f"{prefix}_{name(f)}" for f in features)
    return " UNION ALL ".join(f"SELECT * FROM {n}" for n in names), names


def limits(values: str, by: str, p: float = 0.9) -> str:
    keys = "f_type, comp_type" + (", e1, e2" if by == "entity" else "")
    on = " AND ".join(f"d.{k} IS NOT DISTINCT FROM t.{k}" for k in keys.split(", "))
    low = lambda q: round((100 - q * 100) / 100, 9)
    edge = lambda q: f"coalesce(round(quantile_cont(value, {low(q)}) FILTER (value <> 0), 9), 0.0) AS low, coalesce(round(quantile_cont(value, {q}) FILTER (value <> 0), 9), 1e10) AS high"
    picked = ", ".join(f"t.{k}" for k in keys.split(", "))
    return f"""SELECT {keys}, {edge(p)}, CAST(NULL AS DOUBLE) AS bundle FROM {values} WHERE f_type <> 'delay' GROUP BY {keys}
 UNION ALL SELECT {picked}, low, high, coalesce((SELECT round(quantile_cont(CAST(n AS DOUBLE), {p}) FILTER (n <> 0), 9) FROM {values} d WHERE d.f_type = 'delay' AND d.value > t.high AND {on}), 1e10) AS bundle
 FROM (SELECT {keys}, {edge(0.7)} FROM {values} WHERE f_type = 'delay' AND n > 0 GROUP BY {keys}) t"""


def hles(values: str, limit: str, by: str, traffic: tuple[str, ...] = ("High",)) -> str:
    keys = ["f_type", "comp_type", *(["e1", "e2"] if by == "entity" else [])]
    on = " AND ".join(f"v.{k} IS NOT DISTINCT FROM t.{k}" for k in keys)
    enough = "n > bundle" if by == "type" else "n >= 10"
    classes = ", ".join(f"'{c}'" for c in traffic)
    safe = lambda c: f"replace(replace(coalesce({c}, ''), chr(92), chr(92) || chr(92)), '|', chr(92) || '|')"
    return f"""SELECT *, concat_ws('|', lpad(CAST(w1 AS VARCHAR), 8, '0'), lpad(CAST(w2 AS VARCHAR), 8, '0'), f_type, comp_type, {safe('e1')}, {safe('e2')}, class) AS hle_id FROM (
 SELECT v.*, t.bundle, CASE WHEN value < low THEN 'Low' WHEN value > high THEN 'High' ELSE 'Normal' END AS class FROM {values} v JOIN {limit} t ON {on})
 WHERE class IN ({classes}) AND (f_type <> 'delay' OR {enough})"""


LOG_FEATURES = ("exec", "to-exec", "do", "todo", "busy", "enter", "exit", "cross", "wt", "handover", "workload")
PATH_FEATURES = ("exit", "enter", "handover", "workload", "batch", "delay")
for _key, _set in (("log", LOG_FEATURES), ("path", PATH_FEATURES)):
    CTE[f"{_key}_values"] = union("v", _set)
    CTE[f"{_key}_instances"] = union("i", _set)
    for _by in ("type", "entity"):
        CTE[f"{_key}_limits_{_by}"] = (limits(f"{_key}_values", _by), (f"{_key}_values",))
        CTE[f"{_key}_hles_{_by}"] = (hles(f"{_key}_values", f"{_key}_limits_{_by}", _by), (f"{_key}_values", f"{_key}_limits_{_by}"))

_BOTH = """SELECT x1, x2, y1, y2, max(v) AS v FROM (
 SELECT x1, x2, y1, y2, CAST(n AS DOUBLE) / c AS v FROM {pairs} JOIN {one} ON {on} UNION ALL
 SELECT y1 AS x1, y2 AS x2, x1 AS y1, x2 AS y2, CAST(n AS DOUBLE) / c AS v FROM {pairs} JOIN {one} ON {on}) GROUP BY x1, x2, y1, y2"""
CTE["p_aa"] = (f"SELECT a_i AS x1, {_NULL} AS x2, a_j AS y1, {_NULL} AS y2, count(*) AS n FROM steps GROUP BY a_i, a_j", ("steps",))
CTE["p_rr"] = (f"SELECT r_i AS x1, {_NULL} AS x2, r_j AS y1, {_NULL} AS y2, count(*) AS n FROM steps GROUP BY r_i, r_j", ("steps",))
CTE["p_ss"] = ("SELECT a.a_i AS x1, a.a_j AS x2, b.a_i AS y1, b.a_j AS y2, count(*) AS n FROM steps a JOIN steps b ON a.case_id = b.case_id AND a.pos_j = b.pos_i GROUP BY ALL", ("steps",))
CTE["l_aa"] = (_BOTH.format(pairs="p_aa", one="acts", on="x1 = e"), ("p_aa", "acts"))
CTE["l_rr"] = (_BOTH.format(pairs="p_rr", one="ress", on="x1 = e"), ("p_rr", "ress"))
CTE["l_ss"] = (_BOTH.format(pairs="p_ss", one="segs", on="x1 = a_i AND x2 = a_j"), ("p_ss", "segs"))
CTE["l_as"] = (f"SELECT e AS x1, {_NULL} AS x2, a_i AS y1, a_j AS y2, CAST(s.c AS DOUBLE) / a.c AS v FROM segs s JOIN acts a ON a.e = s.a_i OR a.e = s.a_j", ("segs", "acts"))
CTE["l_ar"] = (f"SELECT act AS x1, {_NULL} AS x2, res AS y1, {_NULL} AS y2, greatest(n / CAST(a.c AS DOUBLE), n / CAST(r.c AS DOUBLE)) AS v FROM (SELECT act, res, count(*) AS n FROM log GROUP BY ALL) l JOIN acts a ON a.e = act JOIN ress r ON r.e = res", ("log", "acts", "ress"))
CTE["l_rs"] = (
    f"SELECT r AS x1, {_NULL} AS x2, h.a_i AS y1, h.a_j AS y2, greatest(n / q.c, n / s.c) AS v FROM (SELECT r, a_i, a_j, count(*) / 2.0 AS n FROM (SELECT r_i AS r, a_i, a_j FROM steps UNION ALL SELECT r_j, a_i, a_j FROM steps) GROUP BY ALL) h JOIN ress q ON q.e = r JOIN segs s ON s.a_i = h.a_i AND s.a_j = h.a_j",
    ("steps", "ress", "segs"),
)
CTE["links"] = (
    "SELECT kind, x1, x2, y1, y2, round(v / max(v) OVER (PARTITION BY kind), 9) AS weight FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS kind, * FROM l_{k}" for k in ("aa", "ss", "as", "rr", "ar", "rs")) + ")",
    tuple(f"l_{k}" for k in ("aa", "ss", "as", "rr", "ar", "rs")),
)
CTE["spread"] = ("SELECT kind, x1, x2, y1, y2, CASE WHEN weight > 0 THEN round(CAST(dense_rank() OVER (PARTITION BY kind ORDER BY weight) AS DOUBLE) / n, 9) ELSE 0.0 END AS weight FROM links JOIN (SELECT kind, count(DISTINCT weight) AS n FROM links WHERE weight > 0 GROUP BY kind) USING (kind)", ("links",))
CTE["either"] = ("SELECT kind, x1, x2, y1, y2, weight FROM spread UNION ALL SELECT reverse(kind), y1, y2, x1, x2, weight FROM spread WHERE substr(kind, 1, 1) <> substr(kind, 2, 1)", ("spread",))
CTE["edges"] = (
    """SELECT a.hle_id AS u, b.hle_id AS v, CASE WHEN a.comp_type = b.comp_type AND a.e1 = b.e1 AND a.e2 IS NOT DISTINCT FROM b.e2 THEN 1.0 ELSE coalesce(l.weight, 0.0) END AS weight
 FROM log_hles_type a JOIN log_hles_type b ON a.w1 + 1 = b.w1 LEFT JOIN either l ON l.kind = substr(a.comp_type, 1, 1) || substr(b.comp_type, 1, 1)
 AND l.x1 = a.e1 AND l.x2 IS NOT DISTINCT FROM a.e2 AND l.y1 = b.e1 AND l.y2 IS NOT DISTINCT FROM b.e2""",
    ("log_hles_type", "either"),
)
CTE["strong"] = ("SELECT u, v, weight FROM edges WHERE weight >= 0.9", ("edges",))
CTE["reach"] = ("SELECT hle_id AS a, hle_id AS b FROM log_hles_type UNION SELECT r.a, e.v FROM reach r JOIN (SELECT u, v FROM strong UNION ALL SELECT v, u FROM strong) e ON e.u = r.b", ("strong", "log_hles_type"))
CTE["cascades"] = ("SELECT a AS hle_id, min(b) AS cascade FROM reach GROUP BY a", ("reach",))
CTE["labelled"] = (
    "SELECT h.*, c.cascade, f_type || '-' || class || '-' || CASE WHEN comp_type = 'segment' THEN '(' || e1 || ',' || e2 || ')' ELSE e1 END AS activity FROM log_hles_type h JOIN cascades c USING (hle_id)",
    ("log_hles_type", "cascades"),
)
CTE["sets"] = ("SELECT h.hle_id, list_sort(list(DISTINCT i.case_id)) AS cases FROM path_hles_type h JOIN path_instances i ON i.f_type = h.f_type AND i.comp_type = h.comp_type AND i.e1 = h.e1 AND i.e2 = h.e2 AND i.w1 = h.w1 AND i.w2 = h.w2 GROUP BY h.hle_id", ("path_hles_type", "path_instances"))
_START = "CASE WHEN w1 = w2 AND f_type IN ('exit', 'workload', 'handover') THEN coalesce({}, w1) ELSE w1 END"
_END = "CASE WHEN w1 = w2 AND f_type = 'enter' THEN coalesce({}, w2) ELSE w2 END"
CTE["spans"] = (f"SELECT hle_id, f_type, e1, e2, {_START.format('w_i_min')} AS start_first, {_START.format('w_i_max')} AS start_last, {_END.format('w_j_min')} AS end_first, {_END.format('w_j_max')} AS end_last FROM path_hles_type", ("path_hles_type",))
CTE["arcs"] = (
    """SELECT src, dst, round(overlap, 9) AS overlap FROM (SELECT a.hle_id AS src, b.hle_id AS dst, CAST(len(list_intersect(s.cases, t.cases)) AS DOUBLE) / len(list_distinct(list_concat(s.cases, t.cases))) AS overlap
 FROM spans a JOIN spans b ON a.e2 = b.e1 AND a.hle_id <> b.hle_id AND ((a.end_first >= b.start_first AND a.end_last <= b.start_last) OR (b.start_first >= a.end_first AND b.start_last <= a.end_last))
 JOIN sets s ON s.hle_id = a.hle_id JOIN sets t ON t.hle_id = b.hle_id) WHERE round(overlap, 9) >= 0.3""",
    ("spans", "sets"),
)
CTE["walk"] = (
    """SELECT [hle_id] AS path, hle_id AS last, cases FROM sets UNION ALL
 SELECT list_append(w.path, a.dst), a.dst, list_sort(list_intersect(w.cases, s.cases)) FROM walk w JOIN arcs a ON a.src = w.last JOIN sets s ON s.hle_id = a.dst
 WHERE NOT list_contains(w.path, a.dst) AND CAST(len(list_intersect(w.cases, s.cases)) AS DOUBLE) / len(list_distinct(list_concat(w.cases, s.cases))) >= 0.3""",
    ("arcs", "sets"),
)
CTE["ended"] = (
    """SELECT row_number() OVER () AS number, path, cases FROM walk w WHERE NOT EXISTS (SELECT 1 FROM walk v WHERE len(v.path) = len(w.path) + 1 AND v.path[1:len(w.path)] = w.path)""",
    ("walk",),
)
CTE["named"] = ("SELECT number, list(h.f_type || ':' || h.e1 || ',' || h.e2 ORDER BY i) AS hla, list(h.e1 ORDER BY i)[1:1] || list(h.e2 ORDER BY i) AS run FROM (SELECT number, unnest(path) AS hle_id, unnest(range(1, len(path) + 1)) AS i FROM ended) JOIN path_hles_type h USING (hle_id) GROUP BY number", ("ended", "path_hles_type"))
CTE["hla"] = ("SELECT array_to_string(hla, '>') AS path, any_value(len(hla)) AS length, any_value(run) AS run, count(*) AS frequency, list_sort(list_distinct(flatten(list(cases)))) AS cases FROM named JOIN ended USING (number) GROUP BY 1", ("named", "ended"))
CTE["pool"] = ("SELECT h.path, c.case_id FROM hla h JOIN flows c ON len(list_filter(range(1, len(c.flow) + 1), lambda i: c.flow[i:i + len(h.run) - 1] = h.run)) > 0", ("hla", "flows"))
CTE["parts_time"] = ("SELECT case_id, CASE WHEN d <= 10 THEN 0 WHEN d < 30 THEN 1 ELSE 2 END AS part FROM (SELECT case_id, floor((max(us) - min(us)) / 86400000000.0) AS d FROM log GROUP BY case_id)", ("log",))
CTE["parts_outcome"] = ("SELECT case_id, CASE WHEN bool_or(act = 'purchase') THEN 0 ELSE 1 END AS part FROM log GROUP BY case_id", ("log",))
CTE["joined"] = ("SELECT hle_id AS a, hle_id AS b FROM path_hles_type UNION SELECT r.a, e.v FROM joined r JOIN (SELECT src AS u, dst AS v FROM arcs UNION ALL SELECT dst, src FROM arcs) e ON e.u = r.b", ("arcs", "path_hles_type"))
_DAY = "CAST(floor(us / 86400000000.0) AS BIGINT) - (SELECT CAST(floor(min(us) / 86400000000.0) AS BIGINT) FROM tied)"
CTE["wt_tied"] = (f"SELECT *, {_DAY} AS w FROM tied", ("tied",))
CTE["wt_steps"] = ("SELECT i.case_id, i.pos AS pos_i, i.act AS a_i, j.act AS a_j, i.res AS r_i, j.res AS r_j, i.w AS w_i, j.w AS w_j FROM wt_tied i JOIN wt_tied j ON i.case_id = j.case_id AND i.tie + 1 = j.tie", ("wt_tied",))
CTE["wt_ends"] = ("SELECT * FROM wt_tied l WHERE NOT EXISTS (SELECT 1 FROM wt_steps s WHERE s.case_id = l.case_id AND s.pos_i = l.pos)", ("wt_tied", "wt_steps"))
RECURSIVE = ("reach", "walk", "joined")


def query(select: str, *needs: str) -> str:
    """``select`` after all expressions that it needs, in an order that defines each before it is used."""
    order: list[str] = []

    def visit(n: str) -> None:
        for m in CTE[n][1]:
            visit(m)
        if n not in order:
            order.append(n)

    for n in needs:
        visit(n)
    recursive = "RECURSIVE " if any(n in RECURSIVE for n in order) else ""
    columns = {"reach": "reach(a, b)", "walk": "walk(path, last, cases)", "joined": "joined(a, b)"}
    return f"WITH {recursive}" + ",\n".join(f"{columns.get(n, n)} AS ({CTE[n][0]})" for n in order) + "\n" + select
