"""Verifier submissions and their median consensus."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinproof.functions.scalar import ratio, short_id, weighted_score
from twinproof.operators.running import group_medians
from twinproof.session import deal_count, dealt, settle

QUORUM = 3
PIVOT_QUORUM = 9
THRESHOLD = 70.0
MAX_VARIANCE = 400.0
MATCH_TOLERANCE = 0.01
AGREEMENT = 5.0
SCORES = ("privacy", "utility", "fairness")
FINALS = ("privacy", "utility", "fairness", "overall")


def requests(data: DataFrame, hash_column: str, created: Column) -> DataFrame:
    """Pending verification requests, one per data hash row."""
    return data.select(
        short_id(F.col(hash_column), created).alias("verification_id"),
        F.col(hash_column).alias("data_hash"),
        created.alias("created_at"),
        F.lit("pending").alias("status"),
    )


def validate_scores(df: DataFrame, scores: Sequence[str] = SCORES) -> DataFrame:
    """Add ``problem``: the first score outside 0..100 (or missing), else null."""
    problem = F.lit(None).cast("string")
    for s in reversed(scores):
        problem = F.when(F.coalesce(F.col(s).between(0, 100), F.lit(False)), problem).otherwise(F.lit(s))
    return df.withColumn("problem", problem)


def validate_required(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Add ``problem``: the first required text field that is empty or null."""
    problem = F.lit(None).cast("string")
    for f in reversed(fields):
        problem = F.when(F.length(F.coalesce(F.col(f), F.lit(""))) > 0, problem).otherwise(F.lit(f))
    return df.withColumn("problem", problem)


def first_submissions(submissions: DataFrame) -> DataFrame:
    """The first submission of each verifier, with its overall score.

    ``arrival`` orders submissions. Later ones of the same verifier are
    refused and only counted. The minimum folds on the map side, so a
    verifier that repeats itself endlessly costs no more than any other.
    """
    firsts = submissions.groupBy("verification_id", "verifier_id").agg(
        F.min(F.struct("arrival", *SCORES)).alias("first"), (F.count("*") - 1).alias("n_refused")
    )
    firsts = firsts.select("verification_id", "verifier_id", "first.*", "n_refused")
    return firsts.withColumn("overall", weighted_score(*[F.col(s) for s in SCORES]))


def signed(submissions: DataFrame) -> DataFrame:
    """Add the 32-digit signature of verifier and overall score."""
    text = F.concat_ws(":", F.col("verifier_id").cast("string"), F.col("overall").cast("decimal(18,6)").cast("string"))
    return submissions.withColumn("signature", F.substring(F.sha2(text, 256), 1, 32))


def _verdict(variance: Column, overall: Column, threshold: float) -> Column:
    # nine digits: the order in which a variance is summed does not decide
    return (
        F.when(F.round(variance, 9) > MAX_VARIANCE, "consensus_failed").when(overall >= threshold, "approved").otherwise("rejected")
    )


def seated(submissions: DataFrame, most: int) -> DataFrame:
    """First submissions with their ``turn``, the first ``most`` verifiers of each request."""
    turn = F.row_number().over(Window.partitionBy("verification_id").orderBy("arrival", "verifier_id"))
    return first_submissions(submissions).withColumn("turn", turn).where(F.col("turn") <= most)


def consensus(submissions: DataFrame, quorum: int = QUORUM, threshold: float = THRESHOLD, keys: Sequence[str] = ("verification_id",)) -> DataFrame:
    """Median consensus of the first ``quorum`` verifiers of each request.

    Reaching the quorum closes a request, so later submissions do not count.
    The rank filter is applied on the map side as well; the medians then see
    at most ``quorum`` rows per request. Rows that have a ``turn`` already (``seated``)
    are not put in order again, and may be panels of several ``keys``.
    """
    if "turn" in submissions.columns:
        within = submissions.where(F.col("turn") <= quorum).withColumn("overall", weighted_score(*[F.col(s) for s in SCORES]))
    else:
        within = seated(submissions, quorum)
    if quorum <= PIVOT_QUORUM:
        # Closed requests have exactly one row per turn: plain maxima per turn
        # stay in generated code, unlike percentile buffers.
        placed = {(s, t): F.max(F.when(F.col("turn") == t, F.col(s))).alias(f"_{s}_{t}") for s in FINALS for t in range(1, quorum + 1)}
        middle = {s: _middle([F.col(f"_{s}_{t}") for t in range(1, quorum + 1)]) for s in FINALS}
        decided = (
            within.groupBy(*keys)
            .agg(F.count("*").alias("num_verifiers"), F.var_pop("overall").alias("variance"), *placed.values())
            .where(F.col("num_verifiers") >= quorum)
            .select(*keys, "num_verifiers", *[m.alias(s) for s, m in middle.items()], "variance")
        )
    else:
        decided = (
            within.groupBy(*keys)
            .agg(F.count("*").alias("num_verifiers"), *[F.median(s).alias(s) for s in FINALS], F.var_pop("overall").alias("variance"))
            .where(F.col("num_verifiers") >= quorum)
        )
    return decided.withColumn("status", _verdict(F.col("variance"), F.col("overall"), threshold))


def _middle(values: Sequence[Column]) -> Column:
    """Median of a handful of columns."""
    ordered = F.array_sort(F.array(*values))
    half = len(values) // 2
    return ordered[half] if len(values) % 2 else (ordered[half - 1] + ordered[half]) / 2


def contract_consensus(submissions: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Ledger-contract variant: median over all submissions, no guard, no quorum."""
    scored = submissions.withColumn("overall", weighted_score(*[F.col(s) for s in SCORES]))
    keys = ["verification_id"]
    medians = group_medians(dealt(scored.select(*keys, "overall"), keys, deal_count(submissions, keys)), keys, ["overall"])
    return medians.select(
        "verification_id",
        F.col("n").alias("verifier_count"),
        F.col("overall").alias("consensus_score"),
        F.when(F.col("overall") >= threshold, "APPROVED").otherwise("REJECTED").alias("final_status"),
    )


def record_status(submissions: DataFrame, threshold: float = 70.0) -> DataFrame:
    """Per-submission contract status: Passed from the threshold up."""
    overall = weighted_score(*[F.col(s) for s in SCORES])
    return submissions.withColumn("overall", overall).withColumn(
        "status", F.when(F.col("overall") >= threshold, "Passed").otherwise("Failed")
    )


def progress(submissions: DataFrame, quorum: int = QUORUM, threshold: float = THRESHOLD) -> DataFrame:
    """Per request: its verdict when reached, else how many results it has."""
    received = first_submissions(submissions).groupBy("verification_id").agg(F.count("*").alias("results_received"))
    done = consensus(submissions, quorum, threshold).select("verification_id", F.col("status").alias("verdict"))
    return received.join(done, "verification_id", "left").select(
        "verification_id",
        F.coalesce("verdict", F.lit("in_progress")).alias("status"),
        F.least("results_received", F.lit(quorum)).alias("results_received"),
        F.lit(quorum).alias("results_needed"),
        F.col("verdict").isNotNull().alias("consensus_reached"),
    )


def signatures_valid(submissions: DataFrame, recompute: bool = False) -> DataFrame:
    """(verification_id, signatures_valid): every signature has the right form, or with
    ``recompute`` is that of its verifier and score."""
    good = F.coalesce(F.col("signature").rlike("^[0-9a-zA-Z]{32}$"), F.lit(False))
    if recompute:
        submissions = signed(submissions.withColumn("_stored", F.col("signature")))
        good = F.col("_stored").eqNullSafe(F.col("signature"))
    return submissions.groupBy("verification_id").agg(F.bool_and(good).alias("signatures_valid"))


def verify_integrity(records: DataFrame, expected: DataFrame, signatures: DataFrame, tolerance: float = MATCH_TOLERANCE, inclusive: bool = False) -> DataFrame:
    """Compare recorded finals with expected ones; both keyed by verification.

    They match below ``tolerance``, or with ``inclusive`` up to it.
    """
    other = expected.select("verification_id", *[F.col(s).alias(f"_e_{s}") for s in FINALS])
    close = F.lit(True)
    for s in FINALS:
        away = F.abs(F.col(s) - F.coalesce(f"_e_{s}", F.lit(0.0)))
        close = close & (away <= tolerance if inclusive else away < tolerance)
    joined = records.join(other, "verification_id").join(signatures, "verification_id", "left")
    return joined.select(
        "verification_id", close.alias("scores_match"), F.coalesce("signatures_valid", F.lit(True)).alias("signatures_valid")
    ).withColumn("valid", F.col("scores_match") & F.col("signatures_valid"))


def statistics(submissions: DataFrame, quorum: int = QUORUM, threshold: float = THRESHOLD) -> DataFrame:
    """One row: completed, pending, outcomes, approval rate, average finals."""
    firsts = first_submissions(submissions).groupBy("verification_id").agg(F.count("*").alias("n"))
    done = consensus(submissions, quorum, threshold)
    pending = firsts.agg(F.count(F.when(F.col("n") < quorum, 1))).scalar()

    def outcome(name: str):
        return F.count(F.when(F.col("status") == name, 1))

    return done.agg(
        F.count("*").alias("total_completed"),
        outcome("approved").alias("approved"),
        outcome("rejected").alias("rejected"),
        outcome("consensus_failed").alias("consensus_failed"),
        ratio(outcome("approved"), F.count("*")).alias("approval_rate"),
        *[F.coalesce(F.avg(s), F.lit(0.0)).alias(f"avg_{s}") for s in SCORES],
    ).withColumn("total_pending", pending)


def agreement_rate(submissions: DataFrame, within: float = AGREEMENT) -> DataFrame:
    """(verification_id, n, agreement): share of scores near the median."""
    keys = ["verification_id"]
    submissions = dealt(submissions.select(*keys, "verifier_id", "arrival", *SCORES), keys, deal_count(submissions, keys))
    firsts = first_submissions(submissions).select("verification_id", "overall")
    middle = group_medians(firsts, ["verification_id"], ["overall"]).withColumnRenamed("overall", "_mid")
    near = (F.abs(F.col("overall") - F.col("_mid")) <= within).cast("double")
    return firsts.join(middle.drop("n"), "verification_id").groupBy("verification_id").agg(
        F.count("*").alias("n"), F.avg(near).alias("agreement")
    )


def judged(requests: DataFrame, submissions: DataFrame, deadline: str, as_of: Column, quorum: int = QUORUM, threshold: float = THRESHOLD) -> DataFrame:
    """Verdicts and rejects of requests and submissions (``output`` tells which).

    ``requests`` has (verification_id, created_at), ``submissions`` (verification_id,
    verifier_id, event_time, place, scores); they count by time, then place. The first
    ``quorum`` verifiers up to ``deadline`` (an interval text) after the request
    have a seat. Every other submission is a reject with its reason: ``unknown``
    (no request before it), ``closed`` (quorum reached), ``expired`` (after the deadline),
    ``duplicate`` (the verifier has a seat), ``invalid`` (no verifier, or a score is missing). A request without quorum whose deadline has passed
    by ``as_of`` has the verdict ``expired``.
    """
    opened = requests.groupBy("verification_id").agg(F.min("created_at").alias("created_at"))
    opened = opened.withColumn("deadline", F.expr(f"created_at + INTERVAL {deadline}"))
    known = submissions.join(opened, "verification_id", "left").withColumn("at", F.struct("event_time", "place"))
    asked = F.coalesce(F.col("created_at") <= F.col("event_time"), F.lit(False))
    whole = F.lit(True)
    for c in ("verifier_id", *SCORES):
        whole = whole & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    timely = known.where(asked & (F.col("event_time") <= F.col("deadline")) & whole)
    first = F.min(F.struct("at", *SCORES)).alias("first")
    order = Window.partitionBy("verification_id").orderBy("first.at", "verifier_id")
    seats = timely.groupBy("verification_id", "verifier_id").agg(first).withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= quorum)
    seats = seats.select("verification_id", "verifier_id", "first.*", "turn").withColumn("overall", weighted_score(*[F.col(s) for s in SCORES]))
    panels = seats.groupBy("verification_id").agg(
        F.count("*").alias("num_verifiers"), F.max("at").alias("closed_at"), F.var_pop("overall").alias("variance"), *[F.median(s).alias(s) for s in FINALS]
    )
    full = panels.where(F.col("num_verifiers") == quorum)
    nothing = {c: F.lit(None).cast(t) for c, t in (("verifier_id", "bigint"), ("place", "bigint"), ("reason", "string"), ("status", "string"), ("num_verifiers", "bigint"), *[(s, "double") for s in FINALS], ("variance", "double"))}
    shape = ["output", "verification_id", "verifier_id", "place", "reason", "num_verifiers", *FINALS, "variance", "status"]

    def rows(frame: DataFrame, output: str) -> DataFrame:
        return frame.withColumns({c: x for c, x in nothing.items() if c not in frame.columns}).withColumn("output", F.lit(output)).select(*shape)

    decided = full.withColumn("status", _verdict(F.col("variance"), F.col("overall"), threshold))
    open_ = opened.where(F.col("deadline") <= as_of).join(panels.select("verification_id", "num_verifiers"), "verification_id", "left")
    open_ = open_.withColumn("num_verifiers", F.coalesce("num_verifiers", F.lit(0))).where(F.col("num_verifiers") < quorum).withColumn("status", F.lit("expired"))
    met = known.join(full.select("verification_id", "closed_at"), "verification_id", "left")
    met = met.join(seats.select("verification_id", "verifier_id", F.col("at").alias("seat_at")), ["verification_id", "verifier_id"], "left")
    reason = (
        F.when(~asked, "unknown")
        .when(F.col("at") > F.col("closed_at"), "closed")
        .when(F.col("event_time") > F.col("deadline"), "expired")
        .when(F.col("at") > F.col("seat_at"), "duplicate")
        .when(~whole, "invalid")
    )
    refused = met.select("verification_id", "verifier_id", "place", reason.alias("reason")).where(F.col("reason").isNotNull())
    return rows(decided.drop("closed_at"), "verdict").unionByName(rows(open_, "verdict")).unionByName(rows(refused, "reject"))


def collusion(submissions: DataFrame, panels: Sequence[int] = (3, 5, 7), threshold: float = THRESHOLD) -> DataFrame:
    """(n, f, verifications, moved, disputed): do f colluding verifiers of n move a verdict?

    Every request with n verifiers is judged by ``consensus`` twice: as it came, and with
    the last f of its first n submissions altered to 0 or 100, whichever is the
    opposite verdict. ``moved`` counts verdicts that changed to the opposite one, ``disputed``
    those that failed on their variance instead.
    """
    whole = Window.partitionBy("verification_id")
    placed = seated(submissions, max(panels)).withColumn("received", F.count("*").over(whole))
    placed = settle(placed.select("verification_id", "turn", "received", *SCORES), "panels")
    out = None
    for n in panels:
        # dealt once by request: the verdicts, their join and the altered panels, many times the rows, stay where they are
        panel = placed.where((F.col("received") >= n) & (F.col("turn") <= n)).drop("received").repartition("verification_id")
        honest = consensus(panel, n, threshold).select("verification_id", F.col("status").alias("honest"))
        judged_ = panel.join(honest.hint("shuffle_hash"), "verification_id").withColumn("f", F.explode(F.array(*[F.lit(f) for f in range(n + 1)])))
        push = F.when(F.col("honest") == "approved", F.lit(0.0)).otherwise(F.lit(100.0))
        bad = F.col("turn") > n - F.col("f")
        altered = judged_.select("verification_id", "f", "honest", "turn", *[F.when(bad, push).otherwise(F.col(s)).alias(s) for s in SCORES])
        after = consensus(altered, n, threshold, keys=("verification_id", "f", "honest"))
        opposite = F.when(F.col("honest") == "approved", "rejected").otherwise("approved")
        counts = after.groupBy(F.lit(n).alias("n"), "f").agg(
            F.count("*").alias("verifications"),
            F.count(F.when(F.col("status") == opposite, 1)).alias("moved"),
            F.count(F.when((F.col("status") == "consensus_failed") & (F.col("honest") != "consensus_failed"), 1)).alias("disputed"),
        )
        out = counts if out is None else out.unionByName(counts)
    return out.withColumn("within_tolerance", F.col("f") <= F.floor((F.col("n") - 1) / 2))


def first_match(requests: DataFrame, pending: DataFrame, within: str) -> DataFrame:
    """(request_id, data_hash, verification_id): the earliest pending verification of a request's
    data hash that was created from the request on, up to ``within`` (an interval text) after it."""
    left = requests.select("request_id", F.col("data_hash").alias("wanted"), "requested_at")
    met = left.join(pending, F.expr(f"wanted = data_hash AND created_at >= requested_at AND created_at <= requested_at + INTERVAL {within}"))
    return met.groupBy("request_id", "data_hash").agg(F.min_by("verification_id", F.struct("created_at", "verification_id")).alias("verification_id"))


def first_pending_request(pending: DataFrame, request_column: str = "data_hash") -> DataFrame:
    """The earliest pending verification of each data hash."""
    return pending.groupBy(request_column).agg(F.min_by("verification_id", F.struct("created_at", "verification_id")).alias("verification_id"))
