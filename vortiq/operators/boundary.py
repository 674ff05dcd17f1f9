"""Boundary-layer parameters and wall friction from mean profiles, as windows and aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio, strict_mean


def velocity_profile(stats: DataFrame, value: str, first: int, last: int) -> DataFrame:
    """Profile over columns first..last: the mean of each row, rows with a missing member left out."""
    return stats.where(F.col("i").between(first, last)).groupBy("j").agg(strict_mean(value).alias("u")).where("u is not null")


def nearest_columns(stats: DataFrame, places: list[float]) -> DataFrame:
    """(place, i): the column nearest in x (the smaller at ties) to each place, of stats with i and x_mm."""
    wanted = F.explode(F.array(*[F.struct(F.lit(k).alias("place"), F.lit(float(x)).alias("at")) for k, x in enumerate(places)])).alias("p")
    rows = stats.select("i", "x_mm").distinct().select("i", "x_mm", wanted)
    return rows.groupBy("p.place").agg(F.min_by("i", F.struct(F.abs(F.col("x_mm") - F.col("p.at")), "i")).alias("i"))


def profile_at(stats: DataFrame, value: str, places: list[float]) -> DataFrame:
    """Profile at one place, or the mean of those at several (a column counts once for each place it is nearest to);
    rows with a missing member left out. stats has j, i, x_mm and the value."""
    own = stats.join(nearest_columns(stats, places), "i")
    return own.groupBy("j").agg(strict_mean(value).alias("u")).where("u is not null")


def numbered(profiles: DataFrame, keys: list[str]) -> DataFrame:
    """profiles (keys, j, u) without zeros and gaps, numbered n from the wall."""
    return profiles.where("u is not null and u <> 0").withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("j")))


def edge_velocity(profiles: DataFrame, keys: list[str], top: int = 5) -> DataFrame:
    """Mean of the `top` largest velocities of each profile."""
    order = Window.partitionBy(*keys).orderBy(F.desc("u"), "j")
    return profiles.where("u is not null").withColumn("_p", F.row_number().over(order)).where(F.col("_p") <= top).groupBy(*keys).agg(F.avg("u").alias("u_edge"))


def integral_params(stats: DataFrame, h: float, dy_mm: float, top: int = 5) -> DataFrame:
    """Of each column i: edge velocity, delta99, displacement and momentum thickness and shape factor.

    Zeros and gaps are left out; fewer than five points, or a profile that doesn't reach 0.99 of the edge velocity,
    give NULL. The r = round(dy / h) points between wall and first point lie on a straight line; their sums are closed.
    """
    r = max(1, int(dy_mm / h + 0.5))
    own = numbered(stats.select("i", "j", F.col("u_mean").alias("u")), ["i"])
    sizes = own.groupBy("i").agg(F.count(F.lit(1)).alias("points")).where("points >= 5")
    own = own.join(sizes, "i").join(edge_velocity(own, ["i"], top).where("u_edge > 0"), "i").withColumn("u99", 0.99 * F.col("u_edge"))
    top_row = Window.partitionBy("i")
    own = own.withColumn("reach", F.min(F.when(F.col("u") > F.col("u99"), F.col("n"))).over(top_row)).withColumn("u1", F.min(F.when(F.col("n") == 1, F.col("u"))).over(top_row))
    inner = F.when(F.col("n") <= F.col("reach"), 1.0).otherwise(0.0)
    sums = own.groupBy("i", "u_edge", "u99", "reach", "u1").agg(F.sum(inner * (1 - F.col("u") / F.col("u99"))).alias("a"), F.sum(inner * F.col("u") * (F.col("u99") - F.col("u"))).alias("b"))
    ok = F.col("reach").isNotNull()
    star = h * (F.col("a") + r - F.col("u1") * (r + 1) / 2 / F.col("u99"))
    theta = h * (F.col("b") + F.col("u99") * F.col("u1") * (r + 1) / 2 - F.col("u1") * F.col("u1") * (r + 1) * (2 * r + 1) / (6 * r)) / (F.col("u99") * F.col("u99"))
    got = sums.select("i", "u_edge", F.when(ok, (F.col("reach") + r) * h).alias("delta99"), F.when(ok, star).alias("delta_star"), F.when(ok, theta).alias("theta"))
    return got.withColumn("shape", ratio("delta_star", "theta"))


def friction_coefficient(number: Column) -> Column:
    return 5e-3 - 2e-4 * number


def clauser_scan(profiles: DataFrame, keys: list[str], u_edge: float, nu: float, h_mm: float, dy_mm: float, kappa: float = 0.41, b: float = 5.0, window: tuple[float, float] = (30.0, 300.0), skip: int = 0) -> DataFrame:
    """Residual (root mean square against the log law, in wall units) of each chart number 0, 0.01 .. 24.

    profiles: keys, n (from the wall), u. Fewer than three points in the window give no row.
    """
    grid = F.explode(F.transform(F.sequence(F.lit(0), F.lit(2400)), lambda k: k / 100.0)).alias("number")
    rows = profiles.select(*keys, "n", "u", grid)
    tau = F.sqrt(friction_coefficient(F.col("number")) * (u_edge**2 / 2))
    rows = rows.withColumn("u_tau", tau).withColumn("y_plus", ((F.col("n") - 1 + skip) * h_mm + dy_mm) * 1e-3 * F.col("u_tau") / nu).where((F.col("y_plus") >= window[0]) & (F.col("y_plus") <= window[1]))
    gap = F.col("u") / F.col("u_tau") - (F.ln("y_plus") / kappa + b)
    return rows.groupBy(*keys, "number").agg(F.sqrt(F.avg(gap * gap)).alias("rmse"), F.count(F.lit(1)).alias("n_points"), F.first("u_tau").alias("u_tau")).where("n_points >= 3")


def clauser_fit(scan: DataFrame, keys: list[str], u_edge: float, digits: int = 9) -> DataFrame:
    """Chart number, friction velocity and coefficient of the least residual (the smaller number at ties, compared to
    so many digits)."""
    best = scan.groupBy(*keys).agg(F.min_by(F.struct("number", "rmse", "u_tau"), F.struct(F.round("rmse", digits), "number")).alias("_b"))
    return best.select(*keys, "_b.number", "_b.rmse", "_b.u_tau", (2 * F.pow(F.col("_b.u_tau") / u_edge, 2)).alias("cf"))


def clauser_at(profiles: DataFrame, keys: list[str], u_edge: float, nu: float, h_mm: float, dy_mm: float, number: float | None = None, u_tau: float | None = None, kappa: float = 0.41, b: float = 5.0, window: tuple[float, float] = (30.0, 300.0), skip: int = 0) -> DataFrame:
    """The log law at a given chart number, or at a given friction velocity: keys, number, u_tau, cf, rmse, n_points.

    A number beyond those of the chart (0 to 24) is refused; fewer than three points in the window leave rmse NULL.
    """
    if (number is None) == (u_tau is None) or (number is not None and not 0 <= number <= 24) or (u_tau is not None and not u_tau > 0):
        raise ValueError("one of a chart number from 0 to 24 and a positive friction velocity is needed")
    tau = u_tau if number is None else ((5e-3 - 2e-4 * number) * u_edge**2 / 2) ** 0.5
    y_plus = ((F.col("n") - 1 + skip) * h_mm + dy_mm) * 1e-3 * tau / nu
    gap = F.when(y_plus.between(*window), F.col("u") / tau - (F.ln(y_plus) / kappa + b))
    got = profiles.groupBy(*keys).agg(F.count(gap).alias("n_points"), F.sqrt(F.avg(gap * gap)).alias("_rmse"))
    return got.select(*keys, F.lit(None if number is None else float(number)).cast("double").alias("number"), F.lit(tau).alias("u_tau"), F.lit(2 * (tau / u_edge) ** 2).alias("cf"), F.when(F.col("n_points") >= 3, F.col("_rmse")).alias("rmse"), "n_points")


def chart_params(profiles: DataFrame, keys: list[str], fit: DataFrame, u_edge: float, nu: float, h: float, dy_mm: float, skip: int = 0) -> DataFrame:
    """Thicknesses, shape and friction Reynolds number of profiles (keys, n, u) with the friction velocity of fit.

    A profile that doesn't reach 0.99 of the edge velocity counts up to its top. The near-wall points on a straight line
    are summed in closed form, as in integral_params().
    """
    r = max(1, int(dy_mm / h + 0.5) + skip)
    u99 = 0.99 * u_edge
    whole = Window.partitionBy(*keys)
    own = profiles.withColumns({"_reach": F.coalesce(F.min(F.when(F.col("u") > u99, F.col("n"))).over(whole), F.max("n").over(whole)), "_u1": F.min(F.when(F.col("n") == 1, F.col("u"))).over(whole)})
    inner = own.where(F.col("n") <= F.col("_reach")).groupBy(*keys).agg(F.max("_reach").alias("reach"), F.max("_u1").alias("u1"), F.sum(1 - F.col("u") / u99).alias("a"), F.sum(F.col("u") * (u99 - F.col("u"))).alias("b"))
    star = h * (F.col("a") + r - F.col("u1") * (r + 1) / 2 / u99)
    theta = h * (F.col("b") + u99 * F.col("u1") * (r + 1) / 2 - F.col("u1") * F.col("u1") * (r + 1) * (2 * r + 1) / (6 * r)) / u99**2
    got = inner.select(*keys, ((F.col("reach") + r) * h).alias("delta99"), star.alias("delta_star"), theta.alias("theta")).join(fit.select(*keys, "u_tau"), keys)
    return got.withColumns({"shape": ratio("delta_star", "theta"), "re_tau": F.col("delta99") * 1e-3 * F.col("u_tau") / nu})


def pick_u_tau(baseline: float, local: float, source: str) -> dict[str, float]:
    """The friction velocity to scale by ("baseline" or "local"), and by how many per cent the local one differs."""
    chosen = {"baseline": baseline, "local": local}[source]
    if not 0 < chosen < float("inf"):
        raise ValueError(f"the {source} friction velocity must be finite and positive")
    return {"u_tau": chosen, "difference_percent": 100 * (local - baseline) / baseline}


def pick_theta(state: DataFrame, source: str, smooth: DataFrame | None = None) -> DataFrame:
    """state (x, theta, ..) with the theta to use: its own ("raw") or that of smooth (x, smooth; "smooth")."""
    if source == "raw":
        return state
    if source != "smooth" or smooth is None:
        raise ValueError("theta is raw or smooth, and a smooth one must be given")
    columns = [F.col("_smooth").alias("theta") if c == "theta" else F.col(c) for c in state.columns]
    return state.join(smooth.select("x", F.col("smooth").alias("_smooth")), "x", "left").select(*columns)


def delta99(profile: DataFrame, u_edge: float) -> DataFrame:
    """First upward crossing of 0.99 of the edge velocity of a profile (y_mm, u), linearly interpolated."""
    order = Window.orderBy("y_mm")
    rows = profile.where("u is not null").withColumns({"_y": F.lead("y_mm").over(order), "_u": F.lead("u").over(order)})
    level = 0.99 * u_edge
    up = rows.where((F.col("u") < level) & (F.col("_u") >= level))
    return up.agg(F.min_by(F.col("y_mm") + (level - F.col("u")) * (F.col("_y") - F.col("y_mm")) / (F.col("_u") - F.col("u")), "y_mm").alias("delta99"))


def system_secant(state: DataFrame, ends: DataFrame, start: tuple[float, ...], polluted: tuple[float, float], full: bool = False, reduce: str = "mean") -> DataFrame:
    """Secant friction coefficient from a state upstream to each requested end (x_end).

    state: x, theta and, for the full equation, ue and delta_star. The start is the mean or median state over start[0]
    <= x < start[1], or, with reduce "places", the mean of the states nearest to the places in start (each column once);
    an end is the column nearest to it (the smaller x at ties). status says why there is no value.
    """
    full_ok = F.col("ue").isNotNull() & F.col("delta_star").isNotNull() if full else F.lit(True)
    own = state.where(F.col("theta").isNotNull() & full_ok)
    f = F.median if reduce == "median" else F.avg
    names = ["x", "theta", *(["ue", "delta_star"] if full else [])]
    bad = lambda c: (F.col(c) >= polluted[0]) & (F.col(c) < polluted[1])
    if reduce == "places":
        wanted = own.select("*", F.explode(F.array(*[F.lit(float(p)) for p in start])).alias("_p"))
        near_to = wanted.groupBy("_p").agg(F.min_by(F.struct(*names), F.struct(F.abs(F.col("x") - F.col("_p")), "x")).alias("s")).select("s.*").distinct()
        inside, source = F.lit(True), near_to
    else:
        inside, source = (F.col("x") >= start[0]) & (F.col("x") < start[1]), own
    first = source.where(inside).agg(*[f(c).alias(f"{c}_s") for c in names], F.max(bad("x")).alias("start_bad"))
    near = ends.join(own, F.lit(True)).groupBy("x_end").agg(F.min_by(F.struct(*names), F.struct(F.abs(F.col("x") - F.col("x_end")), "x")).alias("e"))
    got = near.select("x_end", *[F.col(f"e.{c}").alias(f"{c}_e") for c in names]).join(first, F.lit(True))
    wrong_start = any(polluted[0] <= p < polluted[1] for p in start) if reduce == "places" else start[0] < polluted[1] and start[1] > polluted[0]
    status = F.when(F.lit(wrong_start) | F.col("start_bad") | bad("x_s"), "contaminated_start").when(bad("x_end") | bad("x_e"), "contaminated_endpoint").when(F.col("x_e") <= F.col("x_s"), "invalid_interval").otherwise("ok")
    if full:
        mean2 = (F.col("ue_s") * F.col("ue_s") + F.col("ue_e") * F.col("ue_e")) / 2
        gain = F.col("ue_e") * F.col("ue_e") - F.col("ue_s") * F.col("ue_s")
        half = (F.col("ue_e") * F.col("ue_e") * F.col("theta_e") - F.col("ue_s") * F.col("ue_s") * F.col("theta_s")) / mean2 + (F.col("delta_star_s") + F.col("delta_star_e")) / 2 * gain / (2 * mean2)
    else:
        half = F.col("theta_e") - F.col("theta_s")
    got = got.withColumn("status", status)
    return got.select("x_end", "x_e", "theta_e", "status", F.when(F.col("status") == "ok", ratio(2 * half, F.col("x_e") - F.col("x_s"))).alias("cf"))


def first_run(state: DataFrame, ok: Column, x_min: float, x_max: float) -> DataFrame:
    """The unbroken run of ok columns that begins with the first column of x_min..x_max; empty if that isn't ok."""
    order = Window.orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = state.where(F.col("x").between(x_min, x_max)).withColumn("_gaps", F.sum(F.when(ok, 0).otherwise(1)).over(order))
    return rows.where("_gaps = 0").drop("_gaps")


def calibration_secant(state: DataFrame, x_min: float = 80.0, x_max: float = 328.0, full: bool = True) -> DataFrame:
    """Secant friction coefficient from the first column of the domain to every later one of its unbroken run.

    The full equation sums changes of ue^2 theta and of ue^2 / 2 times delta_star, each over its interval's mean ue^2.
    """
    ok = F.col("theta").isNotNull() & ((F.col("ue") > 0) & F.col("delta_star").isNotNull() if full else F.lit(True))
    run = first_run(state, ok, x_min, x_max)
    order = Window.orderBy("x")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if full:
        u2 = F.col("ue") * F.col("ue")
        before, flux = F.lag(u2).over(order), u2 * F.col("theta")
        mid = (u2 + before) / 2
        piece = (flux - F.lag(flux).over(order)) / mid + (F.col("delta_star") + F.lag("delta_star").over(order)) / 2 * (u2 - before) / 2 / mid
    else:
        piece = F.col("theta") - F.lag("theta").over(order)
    rows = run.withColumn("_piece", piece).withColumns({"_sum": F.sum("_piece").over(upto), "_x0": F.first("x").over(upto)})
    return rows.where("x > _x0").select("x", ratio(2 * F.col("_sum"), F.col("x") - F.col("_x0")).alias("cf"))


def local_momentum(smooth: DataFrame, rho: float = 1.2) -> DataFrame:
    """Local friction coefficient and wall shear from smoothed theta, ue, their slopes and delta_star along x."""
    growth = F.col("dtheta")
    pressure = (2 * F.col("theta") + F.col("delta_star")) / F.col("ue") * F.col("due")
    return smooth.select("x", (2 * growth).alias("cf_zpg"), (2 * (growth + pressure)).alias("cf_full"), (rho * F.col("ue") * F.col("ue") * growth).alias("tau_zpg"), (rho * F.col("ue") * F.col("ue") * (growth + pressure)).alias("tau_full"))


def momentum_quality(local: DataFrame, secant: DataFrame) -> DataFrame:
    """Root mean square, in per cent, of the mean of the local coefficient up to each x against the secant one there;
    NULL for fewer than five points."""
    order = Window.orderBy("x")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    area = (F.col("cf_full") + F.lag("cf_full").over(order)) / 2 * (F.col("x") - F.lag("x").over(order))
    rows = local.withColumn("_a", area).withColumns({"_area": F.sum("_a").over(upto), "_x0": F.first("x").over(upto)}).where("x > _x0")
    both = rows.join(secant, "x").withColumn("_r", ratio(F.col("_area") / (F.col("x") - F.col("_x0")) - F.col("cf"), F.col("cf")))
    return both.agg(F.count("_r").alias("n"), F.when(F.count("_r") >= 5, 100 * F.sqrt(F.avg(F.col("_r") * F.col("_r")))).alias("rms_percent"))


def local_slope(profile: DataFrame, x: str, y: str, half: int = 2) -> DataFrame:
    """Slope at each point of the quadratic fitted to it and `half` neighbours on either side; NULL near the ends."""
    around = Window.orderBy(x).rowsBetween(-half, half)
    rows = profile.withColumn("_w", F.collect_list(F.struct(F.col(x).alias("x"), F.col(y).alias("y"))).over(around))
    total = lambda f: F.aggregate("_w", F.lit(0.0), lambda a, p: a + f(p["x"] - F.col(x), p["y"]))
    sums = {f"_s{k}": total(lambda d, v, k=k: F.pow(d, F.lit(float(k)))) for k in range(1, 5)} | {"_t0": total(lambda d, v: v), "_t1": total(lambda d, v: d * v), "_t2": total(lambda d, v: d * d * v)}
    s0, (s1, s2, s3, s4, t0, t1, t2) = F.lit(2.0 * half + 1), map(F.col, ("_s1", "_s2", "_s3", "_s4", "_t0", "_t1", "_t2"))
    det = s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2)
    slope = s0 * (t1 * s4 - t2 * s3) - t0 * (s1 * s4 - s3 * s2) + s2 * (s1 * t2 - s2 * t1)
    return rows.withColumns(sums).select(*profile.columns, F.when(F.size("_w") == 2 * half + 1, ratio(slope, det)).alias("slope"))


def moving_mean(series: DataFrame, x: str, y: str, half: int = 2) -> DataFrame:
    """Centred moving mean; the window shrinks at the ends and skips missing values."""
    return series.withColumn("smooth", F.avg(y).over(Window.orderBy(x).rowsBetween(-half, half)))


def coherent_energy(profiles: DataFrame, keys: list[str], value: str, share: float = 0.9) -> DataFrame:
    """Energy of each profile (keys, y_mm, value) integrated over y, and the first height that holds the share of it."""
    order = Window.partitionBy(*keys).orderBy("y_mm")
    own = profiles.where(F.col(value).isNotNull())
    area = F.coalesce((F.col(value) + F.lag(value).over(order)) / 2 * (F.col("y_mm") - F.lag("y_mm").over(order)), F.lit(0.0))
    rows = own.withColumn("_a", area).withColumn("_c", F.sum("_a").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("_all", F.sum("_a").over(Window.partitionBy(*keys)))
    return rows.groupBy(*keys).agg(F.max("_all").alias("energy"), F.min(F.when(F.col("_c") >= share * F.col("_all"), F.col("y_mm"))).alias("height"))


def reference_scales(delta99_mm: float, u_tau: float, nu: float) -> dict[str, float]:
    """Friction Reynolds number and the wall-unit limits 2.6 sqrt(Re) and Re / 2."""
    re = delta99_mm * 1e-3 * u_tau / nu
    return {"re_tau": re, "lower_plus": 2.6 * re**0.5, "upper_plus": 0.5 * re}


def chart_curves(chart: DataFrame, n_curves: int = 25) -> DataFrame:
    """Long form (number, x, u) of a chart whose columns c0, c1, .. alternate x and u, numbers falling from n - 1 to 0;
    rows without values are left out."""
    pairs = F.array(*[F.struct(F.lit(n_curves - 1 - k).alias("number"), F.col(f"c{2 * k}").cast("double").alias("x"), F.col(f"c{2 * k + 1}").cast("double").alias("u")) for k in range(n_curves)])
    return chart.select(F.explode(pairs).alias("p")).select("p.*").where("x is not null and u is not null")


def chart_value(curves: DataFrame, number: Column | float, points: DataFrame) -> DataFrame:
    """Value at x of points for a fractional chart number: linear in x on the two curves around it, then in the number."""
    low, high = F.floor(F.lit(number)).cast("int"), F.ceil(F.lit(number)).cast("int")
    order = Window.partitionBy("number").orderBy("_x0")
    spans = curves.where(F.col("number").isin(low, high) | (F.col("number") == low) | (F.col("number") == high)).select("number", F.col("x").alias("_x0"), F.col("u").alias("_u0")).withColumns({"_x1": F.lead("_x0").over(order), "_u1": F.lead("_u0").over(order), "_f": F.row_number().over(order) == 1})
    inside = (F.col("x") <= F.col("_x1")) & ((F.col("x") > F.col("_x0")) | (F.col("_f") & (F.col("x") == F.col("_x0"))))
    on = points.join(spans.where("_x1 is not null"), inside).withColumn("_v", F.col("_u0") + (F.col("_u1") - F.col("_u0")) * (F.col("x") - F.col("_x0")) / (F.col("_x1") - F.col("_x0")))
    part = F.lit(number) - low
    return on.groupBy("x").agg(F.max(F.when(F.col("number") == low, F.col("_v"))).alias("_a"), F.max(F.when(F.col("number") == high, F.col("_v"))).alias("_b")).select("x", (F.col("_a") * (1 - part) + F.col("_b") * part).alias("u"))
