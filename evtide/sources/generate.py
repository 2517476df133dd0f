"""Distributed data generation.

Every random column is a seeded hash of the row index (``xxhash64``), never
``rand()``, so the same parameters give the same rows under any partitioning,
after a retried task, and on any cluster size.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evtide.functions.text import category
from evtide.functions.timefn import parse_ts, ts, utcnow

# The event-type catalogue (name, page), in catalogue order.
EVENT_CATALOGUE = (
    ("user.registered", "/registration"),
    ("user.login", "/login"),
    ("user.logout", "/logout"),
    ("user.updated", "/profile/edit"),
    ("order.created", "/order/create"),
    ("order.paid", "/order/confirm"),
    ("order.shipped", "/order/shipped"),
    ("order.delivered", "/order/tracking"),
    ("payment.processed", "/payment/complete"),
    ("payment.failed", "/payment/failed"),
    ("payment.refunded", "/payment/refund"),
    ("product.viewed", "/product/view"),
    ("product.added_to_cart", "/cart/add"),
    ("product.removed_from_cart", "/cart/remove"),
    ("email.sent", "/emails/sent"),
    ("email.opened", "/emails/opened"),
    ("email.clicked", "/emails/click"),
    ("notification.sent", "/notifications/sent"),
    ("notification.read", "/notifications/read"),
    ("api.request", "/api/request"),
    ("api.response", "/api/response"),
    ("api.error", "/api/error"),
    ("user.password_reset_requested", "/password/reset"),
    ("user.password_changed", "/password/change"),
    ("user.two_factor_enabled", "/security/2fa"),
    ("user.two_factor_disabled", "/security/2fa/disable"),
    ("user.deleted", "/account/delete"),
    ("user.suspended", "/account/suspend"),
    ("user.reactivated", "/account/reactivate"),
    ("user.subscription_started", "/subscription/start"),
    ("user.subscription_cancelled", "/subscription/cancel"),
    ("user.subscription_renewed", "/subscription/renew"),
    ("user.invited", "/invite/send"),
    ("user.invite_accepted", "/invite/accept"),
    ("user.feedback_submitted", "/feedback"),
    ("user.avatar_uploaded", "/profile/avatar"),
    ("user.preferences_updated", "/profile/preferences"),
    ("user.email_verified", "/email/verify"),
    ("user.login_failed", "/login/failed"),
    ("user.profile_viewed", "/profile/view"),
    ("user.notification_preferences_updated", "/profile/notifications"),
    ("user.newsletter_subscribed", "/newsletter/subscribe"),
    ("order.cancelled", "/order/cancel"),
    ("order.return_requested", "/order/return"),
    ("order.return_approved", "/order/return/approved"),
    ("order.return_rejected", "/order/return/rejected"),
    ("order.review_submitted", "/order/review"),
    ("order.invoice_generated", "/order/invoice"),
    ("payment.pending", "/payment/pending"),
    ("payment.disputed", "/payment/dispute"),
    ("payment.settled", "/payment/settled"),
    ("cart.viewed", "/cart/view"),
    ("cart.updated", "/cart/update"),
    ("cart.cleared", "/cart/clear"),
    ("checkout.started", "/checkout/start"),
    ("checkout.completed", "/checkout/complete"),
    ("product.review_submitted", "/product/review"),
    ("product.wishlisted", "/wishlist/add"),
    ("product.unwishlisted", "/wishlist/remove"),
    ("product.compared", "/product/compare"),
    ("product.shared", "/product/share"),
    ("product.restock_requested", "/product/restock"),
    ("product.stock_low", "/product/stock"),
    ("email.bounced", "/emails/bounced"),
    ("email.unsubscribed", "/emails/unsubscribe"),
    ("notification.dismissed", "/notifications/dismiss"),
    ("notification.failed", "/notifications/failure"),
    ("session.started", "/session/start"),
    ("session.expired", "/session/expired"),
    ("session.terminated", "/session/end"),
    ("admin.login", "/admin/login"),
    ("admin.logout", "/admin/logout"),
    ("admin.updated_user", "/admin/user/edit"),
    ("admin.deleted_user", "/admin/user/delete"),
    ("admin.generated_report", "/admin/reports"),
    ("admin.settings_updated", "/admin/settings"),
    ("file.uploaded", "/files/upload"),
    ("file.deleted", "/files/delete"),
    ("file.downloaded", "/files/download"),
    ("file.previewed", "/files/preview"),
    ("support.ticket_created", "/support/create"),
    ("support.ticket_closed", "/support/close"),
    ("support.ticket_reopened", "/support/reopen"),
    ("support.message_sent", "/support/message"),
    ("support.rating_submitted", "/support/rating"),
    ("search.performed", "/search"),
    ("search.filtered", "/search/filter"),
    ("search.sorted", "/search/sort"),
    ("settings.updated", "/settings"),
    ("language.changed", "/settings/language"),
    ("timezone.changed", "/settings/timezone"),
    ("api.token_generated", "/api/token"),
    ("api.token_revoked", "/api/token/revoke"),
    ("api.rate_limited", "/api/rate-limit"),
    ("cron.job_started", "/cron/start"),
    ("cron.job_finished", "/cron/end"),
    ("cron.job_failed", "/cron/failure"),
    ("webhook.received", "/webhooks/incoming"),
    ("webhook.verified", "/webhooks/verified"),
    ("webhook.failed", "/webhooks/failure"),
)

# Generated referrers.
GEN_REFERRERS = (
    "https://google.com", "https://facebook.com", "https://youtube.com",
    "https://twitter.com", "https://instagram.com", "https://tiktok.com",
    "https://linkedin.com", "https://reddit.com", "https://pinterest.com",
    "https://yahoo.com", "https://bing.com", "https://amazon.com", "https://ebay.com",
    "https://wikipedia.org", "https://medium.com", "https://quora.com",
    "https://stackoverflow.com", "https://github.com", "https://netflix.com",
    "https://news.ycombinator.com",
)
# Categories whose events carry a product id; id range;
# session id range; lookback of generated times.
PRODUCT_CATEGORIES = ("product", "order", "cart", "checkout")
PRODUCT_ID_MAX = 5000
SESSION_MIN, SESSION_MAX = 100_000_000, 999_999_999
SPAN_DAYS = 30


def _h(idx: Column, seed: int, salt: int) -> Column:
    """Non-negative seeded hash of a row index, one stream per ``salt``."""
    return F.abs(F.xxhash64(idx, F.lit(seed), F.lit(salt)) % F.lit(2 ** 62))


def users(spark: SparkSession, count: int, created_at=None) -> DataFrame:
    """``User1 .. UserN`` with one creation time (G1); ids 1..N."""
    at = parse_ts(created_at) or utcnow()
    return spark.range(1, count + 1).select(
        F.col("id"), F.concat(F.lit("User"), F.col("id").cast("string")).alias("name"),
        ts(at).alias("created_at"))


def event_types(spark: SparkSession, count: int) -> DataFrame:
    """``count`` types from the catalogue (G2), ids 1..count.

    Past the catalogue's size names repeat with a deterministic round suffix
    ``_v2``, ``_v3`` ... (unique, unlike a random suffix); their page is
    ``/unknown``.
    """
    cat = spark.createDataFrame(
        [(i, n, p) for i, (n, p) in enumerate(EVENT_CATALOGUE)], "slot int, base string, page string")
    size = len(EVENT_CATALOGUE)
    idx = spark.range(count).select(F.col("id").alias("i"),
                                    (F.col("id") % size).cast("int").alias("slot"))
    j = idx.join(F.broadcast(cat), "slot")  # the catalogue: a fixed 100 rows
    rnd = (F.col("i") / size).cast("long")
    return j.select(
        (F.col("i") + 1).cast("int").alias("id"),
        F.when(rnd == 0, F.col("base")).otherwise(
            F.concat(F.col("base"), F.lit("_v"), (rnd + 1).cast("string"))).alias("name"),
        F.when(rnd == 0, F.col("page")).otherwise(F.lit("/unknown")).alias("page"))


def events(spark: SparkSession, count: int, user_ids: DataFrame, types: DataFrame,
           as_of=None, seed: int = 42, offset: int = 0,
           num_partitions: int | None = None) -> DataFrame:
    """``count`` events (G3), row i = offset .. offset+count-1:

    user = i-th user (round robin over ``user_ids`` ordered by ``idx``, a dense
    0-based index), type = i-th type (round robin), time = uniform second in
    the 30 days before ``as_of``, metadata = page of the type (``/unknown``
    if none), referrer from the list, 9-digit session id, and product id
    1..5000 only for product / order / cart / checkout types.

    ``user_ids`` (idx, user_id) and ``types`` (id, name, page) are joined on
    the row index modulo their sizes; Spark picks broadcast or shuffle by their
    size.
    """
    at = parse_ts(as_of) or utcnow()
    span = SPAN_DAYS * 86400
    n_users = user_ids.count()
    n_types = types.count()
    rows = spark.range(offset, offset + count, numPartitions=num_partitions).select(
        F.col("id").alias("i"))
    rows = rows.select(
        "i", (F.col("i") % n_users).alias("idx"),
        ((F.col("i") % n_types) + 1).cast("int").alias("type_idx"),
        _h(F.col("i"), seed, 1).alias("h_ts"), _h(F.col("i"), seed, 2).alias("h_ref"),
        _h(F.col("i"), seed, 3).alias("h_ses"), _h(F.col("i"), seed, 4).alias("h_pid"))
    t = types.select(F.col("id").alias("type_idx"), F.col("name").alias("event_type"), "page")
    j = rows.join(user_ids, "idx").join(t, "type_idx")
    refs = F.array(*[F.lit(r) for r in GEN_REFERRERS])
    product = F.when(category("event_type").isin(*PRODUCT_CATEGORIES),
                     (F.col("h_pid") % PRODUCT_ID_MAX + 1).cast("int"))
    meta = F.to_json(F.struct(
        F.coalesce("page", F.lit("/unknown")).alias("page"),
        product.alias("product_id"),
        F.element_at(refs, (F.col("h_ref") % len(GEN_REFERRERS) + 1).cast("int")).alias("referrer"),
        (F.col("h_ses") % (SESSION_MAX - SESSION_MIN) + SESSION_MIN).cast("string")
        .alias("session_id")))
    start = ts(at - dt.timedelta(days=SPAN_DAYS))
    return j.select(
        F.col("user_id"), "event_type",
        (start + F.make_dt_interval(secs=(F.col("h_ts") % span).cast("long"))).alias("timestamp"),
        meta.alias("metadata"), F.col("i").alias("seq"))
