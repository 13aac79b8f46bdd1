"""SQL of what needs a linear solve: Gauss-Jordan elimination as a recursive query, and estimators built on it."""

from __future__ import annotations

from ..operators.traffic import NAMES


def solve(systems: str, name: str) -> str:
    """Tables that solve systems(key, i, n, r): rows i = 0..n-1 of n coefficients and right-hand sides; name has (key, i, x), x all sides.

    Without pivoting: for positive definite matrices.
    """
    return f"""{name}_steps(key, k, i, n, r) as (
        select key, 0, i, n, r from {systems} union all
        select a.key, a.k + 1, a.i, a.n, case when a.i = a.k then list_transform(a.r, lambda v: v / a.r[a.k + 1]) else list_transform(list_zip(a.r, p.r), lambda z: z[1] - a.r[a.k + 1] / p.r[a.k + 1] * z[2]) end
        from {name}_steps a join {name}_steps p on p.key = a.key and p.i = a.k where a.k < a.n),
    {name} as (select key, i, r[n + 1:] x from {name}_steps where k = n)"""


SCORES = "round(sqrt(avg(power(e - z, 2))), 6) + 0.0 rmse, round(avg(e - z), 6) + 0.0 mb, round(corr(e, z), 6) + 0.0 cor, round(1 - sum(abs(e - z)) / nullif(sum(abs(z - m)), 0), 6) + 0.0 coe, count(*) n"


def scored(model: str, rows: str) -> str:
    """Scores of rows (station, t, z, e) with an estimate."""
    return f"select '{model}' model, station, {SCORES} from (select *, avg(z) over (partition by station) m from ({rows}) where e is not null) group by station"


def split(cut: int) -> str:
    return f"past as (select * from sparse where t < {cut}), future as (select * from sparse where t >= {cut})"


#: For each station held out (fold), the others numbered from 0.
OTHERS = "names as (select distinct station from past), others as (select f.station fold, o.station, row_number() over (partition by f.station order by o.station) - 1 i, count(*) over (partition by f.station) n from names f join names o on o.station <> f.station)"
PAIRS = "pair as (select a.station a, b.station b, coalesce(corr(a.z, b.z), 0) c, avg(a.z * b.z) p from past a join past b using (t) group by 1, 2)"
MEANS = "means as (select station, avg(z) m from past group by 1)"


def linear(weights: str) -> str:
    """(station, t, z, e) of the future from weights(fold, station, w, centre, off), where all the others have a value."""
    return f"select f.station, f.t, f.z, e from (select fold, t, max(off) + sum(w * (z - centre)) e from future join {weights} w using (station) group by fold, t, w.n having count(*) = w.n) x join future f on f.station = x.fold and f.t = x.t"


def blue(cut: int, distrust: float) -> str:
    return f"""{split(cut)}, {OTHERS}, {PAIRS}, {MEANS},
    lines as (select o.fold key, o.i, o.n, list(p.c + case when o.i = q.i then {distrust} else 0 end order by q.i) || [max(t.c)] r
        from others o join others q on q.fold = o.fold join pair p on p.a = o.station and p.b = q.station join pair t on t.a = o.station and t.b = o.fold group by 1, 2, 3),
    {solve('lines', 'solution')},
    weights as (select o.fold, o.station, o.n, x[1] w, a.m centre, b.m off from others o join solution s on s.key = o.fold and s.i = o.i join means a on a.station = o.station join means b on b.station = o.fold)
    {scored('BLUE', linear('weights'))}"""


def kriging(cut: int, kernel: str, delta: float, old: bool = False) -> str:
    """kernel is SQL in d."""
    a, b, c = ("1", str(delta), "1") if old else (str(1 - delta), str(delta), str(1 - delta))
    share = "x[1]" if old else "x[1] / sum(x[1]) over (partition by o.fold)"
    return f"""{split(cut)}, near as (select p.station a, q.station b, sqrt(power(p.x - q.x, 2) + power(p.y - q.y, 2)) d from positions p, positions q), kernel as (select a, b, {kernel} k from near),
    names as (select distinct station from past where station in (select station from positions)), {OTHERS.partition('), ')[2]},
    lines as (select o.fold key, o.i, o.n, list(k.k * {a} + case when o.i = q.i then {b} else 0 end order by q.i) || [max(t.k) * {c}] r
        from others o join others q on q.fold = o.fold join kernel k on k.a = o.station and k.b = q.station join kernel t on t.a = o.station and t.b = o.fold group by 1, 2, 3),
    {solve('lines', 'solution')},
    weights as (select o.fold, o.station, o.n, {share} w, 0 centre, 0 off from others o join solution s on s.key = o.fold and s.i = o.i)
    {scored('Kriging', linear('weights'))}"""


def nonnegative(grams: str, moments: str, n: int) -> str:
    """Tables that give best(key, x): nonnegative least squares of n variables, the best feasible of all choices of which are 0.

    grams has (key, i, j, v), moments (key, i, v); i and j count from 0.
    """
    return f"""chosen as (select range chosen from range({1 << n})),
    lines as (select {{'key': g.key, 'chosen': chosen}} key, g.i, {n} n, list(case when (chosen >> g.i) & (chosen >> g.j) & 1 = 1 then g.v when g.i = g.j then 1.0 else 0.0 end order by g.j) || [case when (chosen >> g.i) & 1 = 1 then max(m.v) else 0.0 end] r
        from {grams} g join {moments} m on m.key = g.key and m.i = g.i, chosen group by g.key, chosen, g.i),
    {solve('lines', 'solution')},
    tried as (select s.key.key key, list(x[1] order by s.i) x, sum(x[1] * m.v) gain from solution s join {moments} m on m.key = s.key.key and m.i = s.i group by s.key having min(x[1]) >= 0),
    best as (select key, arg_max(x, gain) x from tried group by key)"""


def snapshot_weights(cut: int) -> str:
    return f"""{split(cut)}, {OTHERS}, {PAIRS},
    grams as (select o.fold key, o.i, q.i j, p.p v from others o join others q on q.fold = o.fold join pair p on p.a = o.station and p.b = q.station),
    moments as (select o.fold key, o.i, p.p v from others o join pair p on p.a = o.station and p.b = o.fold),
    {nonnegative('grams', 'moments', 9)},
    weights as (select o.fold, o.station, o.n, x[o.i + 1] w from others o join best on key = o.fold)"""


def snapshot_weighted(cut: int) -> str:
    rows = "select f.station, f.t, f.z, e from (select fold, t, sum(w * z) * max(n) / count(*) e from future join weights using (station) group by 1, 2) x join future f on f.station = x.fold and f.t = x.t"
    return f"{snapshot_weights(cut)} {scored('SnapshotWeighted', rows)}"


def quantile(cut: int) -> str:
    return f"""{split(cut)}, line as (select station, z, row_number() over (partition by station order by z, t) - 1 k, count(*) over (partition by station) n from past),
    ranks as (select f.station, f.t, count(*) filter (p.z < f.z) / count(*) r from future f join past p using (station) group by 1, 2),
    wanted as (select fold, t, station, q * (n - 1) place from (select f.station fold, t, median(r) q from ranks r join (select distinct station from future) f on f.station <> r.station group by 1, 2) join (select distinct station, n from line) on station <> fold),
    read as (select fold, t, avg(lo.z + (place - floor(place)) * (hi.z - lo.z)) e from wanted w join line lo on lo.station = w.station and lo.k = floor(place) join line hi on hi.station = w.station and hi.k = ceil(place) group by 1, 2)
    {scored('SnapshotQuantile', 'select f.station, f.t, z, e from future f join read r on r.fold = f.station and r.t = f.t')}"""


FEATURES = "features as (select t, 's' || (pixel % 10) station, [" + ", ".join(f"count(*) filter (colour = {k}) / count(*)" for k in range(1, 5)) + "] f from pixels group by 1, 2)"


def _based(table: str) -> str:
    """(t, station, z, base): base is the mean of the other stations at t."""
    return f"(select t, station, z, (sum(z) over (partition by t) - z) / nullif(count(*) over (partition by t) - 1, 0) base from {table})"


def _regressed(learn: str, n: int, alpha: float, positive: bool) -> str:
    """Tables to coefficients(w, b) of learn(f, y), n features; ridge with alpha on centred data."""
    v = f"(select list_concat(f, [y]) v from {learn})"
    sums = f"""sums as (select i, j, sum(v[i + 1] * v[j + 1]) - sum(v[i + 1]) * sum(v[j + 1]) / count(*) c from {v}, (select range i from range({n + 1})), (select range j from range({n + 1})) group by 1, 2),
    centre as (select i, avg(v[i + 1]) m from {v}, (select range i from range({n + 1})) group by 1)"""
    if positive:
        solved = f"grams as (select 0 key, i, j, c v from sums where i < {n} and j < {n}), moments as (select 0 key, i, c v from sums where i < {n} and j = {n}), {nonnegative('grams', 'moments', n)}"
    else:
        solved = f"lines as (select 0 key, i, {n} n, list(c + case when i = j then {alpha} else 0 end order by j) r from sums where i < {n} group by i), {solve('lines', 'solution')}, best as (select list(x[1] order by i) x from solution)"
    b = f"(select m from centre where i = {n}) - (select sum(x[i + 1] * m) from centre where i < {n})"
    return f"{sums}, {solved}, coefficients as (select x w, {b} b from best)"


def regression(cut: int, alpha: float = 0.0, positive: bool = False) -> str:
    rows = f"select station, t, z, base + list_dot_product(w, f) + b e from {_based('future')} join features using (t, station), coefficients"
    return f"""{split(cut)}, {FEATURES}, learn as (select f, z - base y from {_based('past')} join features using (t, station) where base is not null),
    {_regressed('learn', 4, alpha, positive)} {scored('Regression', rows)}"""


def sequence(cut: int) -> str:
    rows = f"select station, t, z, base + list_dot_product(w, f) + b e from {_based('future')} join features using (t, station), coefficients"
    return f"""{split(cut)}, {FEATURES}, learn as (select f, z - coalesce(base, 0) y from {_based('past')} join features using (t, station)),
    {_regressed('learn', 4, 1.0, False)} {scored('Sequence', rows)}"""


def sequence_transitions(cut: int) -> str:
    """Each step's estimates go through a line fitted to what was left before it."""
    rows = "select station, t, z, coalesce(m.intercept + m.slope * base, null) + coalesce(l.intercept + l.slope * (list_dot_product(w, f) + b), 0) e from future_based join features using (t, station), coefficients, mean_line m, line l"
    return f"""{split(cut)}, {FEATURES}, past_based as (select * from {_based('past')}), future_based as (select * from {_based('future')}),
    mean_line as (select regr_slope(z, base) slope, regr_intercept(z, base) intercept from past_based where base is not null),
    left_over as (select p.t, p.station, z - coalesce(intercept + slope * base, 0) y from past_based p, mean_line),
    learn as (select f, y from left_over join features using (t, station)), {_regressed('learn', 4, 1.0, False)},
    line as (select regr_slope(y, g) slope, regr_intercept(y, g) intercept from (select y, list_dot_product(w, f) + b g from learn, coefficients))
    {scored('Sequence', rows)}"""


def traffic_mean(cut: int) -> str:
    """Least squares on the numbers of pixels of each colour at the time, the same for all stations."""
    counts = ", ".join(f"cast(count(*) filter (colour = {k}) as double)" for k in range(1, 5))
    rows = "select station, t, z, list_dot_product(w, f) + b e from future join features using (t), coefficients"
    return f"""{split(cut)}, features as (select t, [{counts}] f from pixels group by 1), learn as (select f, z y from past join features using (t)),
    {_regressed('learn', 4, 0.0, False)} {scored('Regression', rows)}"""


def node_regression(day: int, features: str, alpha: float) -> str:
    """Ridge on features (t, node, colours) of the largest component's nodes, over the mean of users that are nodes, by day."""
    f = ", ".join(NAMES)
    return f"""{COMPONENT}, users as (select cast(floor(floor(epoch(ts) / 3600) / 24) as bigint) t, user_id station, avg(value) z from events where user_id in (select node from largest) group by 1, 2),
    raw as ({features}), features as (select t, node station, [{f}] f from raw), past as (select * from users where t < {day}), future as (select * from users where t >= {day}),
    learn as (select f, z - base y from {_based('past')} join features using (t, station) where base is not null), {_regressed('learn', 4, alpha, False)}
    {scored('Regression', f"select cast(station as varchar) station, t, z, base + list_dot_product(w, f) + b e from {_based('future')} join features using (t, station), coefficients")}"""


def three(part: str, name: str) -> str:
    """Table name(model, station, t, e, z): the estimates of the mean, the inverse variances and the distances for a part of the panel."""
    return f"""{name}_near as (select p.station fold, q.station, exp(-5 * sqrt(power(p.x - q.x, 2) + power(p.y - q.y, 2))) w from positions p join positions q on p.station <> q.station),
    {name}_variance as (select station, 1 / nullif(var_samp(z), 0) w from past group by 1),
    {name} as (select 'mean' model, station, t, base e, z from {_based(part)} where base is not null
        union all select 'invvar', f.station, f.t, sum(v.w * o.z) / sum(v.w), max(f.z) from {part} f join {part} o on o.t = f.t and o.station <> f.station join {name}_variance v on v.station = o.station where f.station in (select station from {name}_variance where w is not null) and v.w is not null group by 2, 3
        union all select 'distance', f.station, f.t, sum(d.w * o.z) / sum(d.w), max(f.z) from {part} f join {name}_near d on d.fold = f.station join {part} o on o.t = f.t and o.station = d.station group by 2, 3)"""


#: Models numbered from 0, and their estimates side by side.
BOTH = """numbered as (select row_number() over (order by model) - 1 i, model from (select distinct model from p)),
    joined as (select station, t, a.model ma, x.i, b.model mb, y.i j, a.e ea, b.e eb, a.z from p a join p b using (station, t) join numbered x on x.model = a.model join numbered y on y.model = b.model)"""


def aggregator_weights(cut: int) -> str:
    return f"""{split(cut)}, {three('past', 'p')}, {BOTH}, errors as (select ma, mb, i, j, avg((ea - z) * (eb - z)) c from joined group by 1, 2, 3, 4), mse as (select ma model, c from errors where i = j),
    lines as (select 0 key, i, 3 n, list(c order by j) || [1.0] r from errors group by i), {solve('lines', 'solution')}
    select how, model, round(w, 6) + 0.0 weight from (select 'average' how, model, 1 / 3 w from mse union all select 'mse', model, (1 / c) / sum(1 / c) over () from mse
        union all select 'std', model, power(c, -0.5) / sum(power(c, -0.5)) over () from mse union all select 'blue', model, x[1] / sum(x[1]) over () from solution join numbered using (i))"""


def aggregator_stacked(cut: int) -> str:
    rows = "select station, t, max(z) z, sum(x[i + 1] * e) e from f3 join numbered using (model), best group by 1, 2 having count(e) = 3"
    return f"""{split(cut)}, {three('past', 'p')}, {BOTH}, grams as (select 0 key, i, j, sum(ea * eb) v from joined group by 2, 3), moments as (select 0 key, i, sum(ea * z) v from joined where i = j group by 2),
    {nonnegative('grams', 'moments', 3)}, {three('future', 'f3')} {scored('stacked', rows)}"""


def aggregator_nested(cut: int) -> str:
    rows = "select station, t, max(z) z, sum(w * e) e from p join weights using (station, model) group by 1, 2 having count(e) = 3"
    return f"""{split(cut)}, {three('past', 'p')}, folds as (select s.station, p.model, 1 / avg(power(e - z, 2)) w from p join (select distinct station from p) s on s.station <> p.station group by 1, 2),
    weights as (select station, model, w / sum(w) over (partition by station) w from folds) {scored('ensemble', rows)}"""


COMPONENT = """reach as (select distinct node source, node from ends union select c.source, e.other from reach c join ends e on e.node = c.node), parts as (select node, min(source) component from reach group by 1),
    largest as (select node, row_number() over (order by node) - 1 i, count(*) over () n from parts where component = (select component from parts group by 1 order by count(*) desc, component limit 1)),
    street as (select a.i, b.i j, length, lanes from ends e join largest a on a.node = e.node join largest b on b.node = e.other)"""
SOURCE = """field as (select q.t, n.node, sum((q.green * 0.1 + q.yellow * 0.3 + q.red * 0.7 + q.dark_red * 1.5) * n.length * n.lanes / 2) / max(d.degree) z
        from traffic_edge q join ends n on q.u = least(n.node, n.other) and q.v = greatest(n.node, n.other) join degrees d on d.node = n.node where n.node in (select node from largest) group by 1, 2),
    days as (select t, row_number() over (order by t) k from (select distinct t from field))"""


def _lines(off: str, diagonal: str, other: str, sides: str) -> str:
    """Rows of the matrix with these entries (in a street's length; other where there is no street) and the lists of sides(node, s)."""
    return f"""entries as (select i, j, {off} v from street union all select i, i, {diagonal} from street group by i), sides as ({sides}),
    lines as (select 0 key, l.i, l.n, list(coalesce(e.v, {other}) order by m.i) || any_value(s.s) r
        from largest l join sides s on s.node = l.node cross join largest m left join entries e on e.i = l.i and e.j = m.i group by l.i, l.n)"""


def field_solution(off: str, diagonal: str) -> str:
    sides = "select l.node, list(coalesce(f.z, 0.0) order by k) s from largest l cross join days left join field f on f.t = days.t and f.node = l.node group by 1"
    return f"""{COMPONENT}, {SOURCE}, {_lines(off, diagonal, '0.0', sides)}, {solve('lines', 'solution')}
    select t, node, round(x[k], 6) + 0.0 z from solution join largest using (i), days"""


def _resistances() -> str:
    """Tables up to r(a, b, r)."""
    share = "1 / (select max(n) from largest)"  # with it everywhere, the Laplacian has an inverse that gives the same distances
    sides = "select a.node, list(case when a.i = b.i then 1.0 else 0.0 end order by b.i) s from largest a cross join largest b group by 1"
    return f"""{COMPONENT}, {_lines(f'{share} - 1 / length', f'sum(1 / length) + {share}', '1 / l.n', sides)}, {solve('lines', 'solution')},
    r as (select p.node a, q.node b, round(s.x[p.i + 1] + t.x[q.i + 1] - 2 * s.x[q.i + 1], 4) + 0.0 r from largest p join largest q on q.i < p.i join solution s on s.i = p.i join solution t on t.i = q.i)"""


def resistance() -> str:
    return f"{_resistances()} select a, b, r from r"


def spectrum_counts(bounds: tuple[float, ...]) -> str:
    """Eigenvalues of the normalised Laplacian below each bound: as many as negative pivots when the matrix less the bound is eliminated."""
    return f"""numbered as (select node, degree, row_number() over (order by node) - 1 i, count(*) over () n from degrees),
    off as (select a.i, b.i j, -sum(length * lanes) / sqrt(any_value(a.degree) * any_value(b.degree)) v from ends e join numbered a on a.node = e.node join numbered b on b.node = e.other group by 1, 2),
    lines as (select bound key, a.i, a.n, list(coalesce(off.v, case when a.i = b.i then 1 - bound else 0.0 end) order by b.i) r
        from numbered a cross join numbered b cross join (select unnest({list(bounds)}) bound) left join off on off.i = a.i and off.j = b.i group by 1, 2, 3),
    {solve('lines', 'solution')}
    select cast(key as double) bound, count(*) filter (r[k + 1] < 0) n from solution_steps where i = k and k < n group by 1"""


def principal_spectrum() -> str:
    """Sums of the eigenvalues of field's covariance and, as shares of their sum, of their squares and cubes: traces of the centred Gram matrix over times."""
    return """days as (select distinct t from field), products as (select a.t, b.t s, sum(a.z * b.z) g from field a join field b using (node) group by 1, 2),
    gram as (select a.t, b.t s, coalesce(g, 0) g from days a cross join days b left join products p on p.t = a.t and p.s = b.t),
    centred as (select t, s, g - avg(g) over (partition by t) - avg(g) over (partition by s) + avg(g) over () c from gram),
    total as (select sum(c) v, count(*) n from centred where t = s)
    select 1 power, round(v / n, 5) value from total union all select 2, round((select sum(c * c) from centred) / (v * v), 5) from total
    union all select 3, round((select sum(a.c * b.c * d.c) from centred a join centred b on b.t = a.s join centred d on d.t = b.s and d.s = a.t) / (v * v * v), 5) from total"""


def rate_search(cut: int, low: float, high: float, steps: int) -> str:
    """The least error over a grid of rates, the same for each way to search."""
    return f"""{split(cut)}, own as (select * from past join positions using (station)),
    near as (select a.station, a.t, a.z truth, b.z, sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) d from own a join own b on a.t = b.t and a.station <> b.station),
    rates as (select {low} * power({high} / {low}, k / {steps - 1}.0) rate from (select unnest(range({steps})) k)),
    losses as (select rate, avg(power(e - truth, 2)) loss from (select rate, station, t, max(truth) truth, sum(exp(-rate * d) * z) / sum(exp(-rate * d)) e from near, rates group by 1, 2, 3) group by 1)
    select method, round(min(loss), 1) loss from losses, (select unnest(['loguniform', 'evolution', 'surrogate', 'descend']) method) group by 1"""


def diffusion_loss(cut: int, diffusion: float) -> str:
    """Weights of the colours' diffused fields and the mean square error at the sensors before the day cut, for one diffusion."""
    colours = ", ".join(f"sum(q.{c} * n.length * n.lanes / 2) / max(d.degree)" for c in NAMES)
    k = len(NAMES)
    sides = f"select l.node, list(coalesce(f.v[c], 0.0) order by k, c) s from largest l cross join days cross join (select unnest(range(1, {k + 1})) c) left join colours f on f.t = days.t and f.node = l.node group by 1"
    return f"""{COMPONENT}, colours as (select q.t, n.node, [{colours}] v from traffic_edge q join ends n on q.u = least(n.node, n.other) and q.v = greatest(n.node, n.other)
        join degrees d on d.node = n.node where n.node in (select node from largest) group by 1, 2),
    days as (select t, row_number() over (order by t) k from (select distinct t from colours)),
    {_lines(f'length / 6 - {diffusion} / length', f'sum(length / 3 + {diffusion} / length)', '0.0', sides)}, {solve('lines', 'solution')},
    seen as (select cast(floor(epoch(ts) / 86400) as bigint) t, user_id node, avg(value) z from events where user_id in (select node from largest) group by 1, 2 having t < {cut}),
    rows as (select seen.t, seen.node, z - avg(z) over (partition by seen.t) y, coalesce(x[(k - 1) * {k} + 1:k * {k}], {[0.0] * k}) f
        from seen join largest using (node) left join days on days.t = seen.t left join solution using (i)),
    terms as (select unnest(range({k})) i),
    normal as (select 0 key, a.i, {k} n, list(g order by j) || [any_value(m)] r from (select a.i, b.i j, sum(f[a.i + 1] * f[b.i + 1]) g, sum(f[a.i + 1] * y) m from rows, terms a, terms b group by 1, 2) a group by a.i),
    {solve('normal', 'w')},
    loss as (select avg(power(e - y, 2)) v from (select t, node, any_value(y) y, sum(x[1] * f[i + 1]) e from rows, w group by 1, 2))
    select {list(NAMES)}[i + 1] term, round(x[1], 4) + 0.0 value from w union all select 'loss', round(v, 4) + 0.0 from loss"""


def corr_vs_resistance() -> str:
    """Correlation of two sensors beside the resistance between them."""
    return f"""{_resistances()},
    seen as (select cast(floor(epoch(ts) / 86400) as bigint) t, user_id node, avg(value) z from events where user_id in (select node from largest) group by 1, 2),
    c as (select x.node a, y.node b, corr(x.z, y.z) c, count(*) n from seen x join seen y on x.t = y.t and x.node > y.node group by 1, 2 having count(*) >= 5)
    select a, b, r, round(c, 6) + 0.0 corr, n from r join c using (a, b)"""
