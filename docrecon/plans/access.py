"""Request limits, failed logins and revoked tokens over the tables."""

from pyspark.sql import functions as F

from docrecon.registry import query
from docrecon.sources.tables import NOW, WITH, table
from docrecon.streaming.jobs import failed_logins, rate_limit, revoked_tokens


def requests(spark, d):
    """Each login as a request, from few addresses."""
    logins = table(spark, d, "v_logins")
    return logins.select(F.when(F.col("failed"), "reset").otherwise("login").alias("route"), "ip", "id", F.unix_micros(F.col("at").cast("timestamp")).alias("micros"))


# No SQL: what was rejected earlier decides what counts later. The tests hold it against a loop over all requests.
@query("str1_rate_limit")
def str1(spark, d):
    return rate_limit(requests(spark, d), 5, 300 * 60)


@query("str2_failed_login_windows", WITH + """, w AS (SELECT time_bucket(INTERVAL '1 minute', v_logins.at) - to_minutes(i) AS start, lower(trim(email)) AS email, ip FROM v_logins, range(15) t(i) WHERE failed)
SELECT strftime(start, '%Y-%m-%d %H:%M') AS start, email, ip, count(*) AS n FROM w GROUP BY ALL HAVING count(*) >= 2""")
def str2(spark, d):
    return failed_logins(table(spark, d, "v_logins"), 2).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm"))


@query("str3_token_blacklist", WITH + f""", r AS (SELECT user_id AS jti, ts AS revoked_at, ts + INTERVAL '20' DAY AS expires_at FROM events WHERE event_type = 'error'), f AS (SELECT jti, min(revoked_at) AS revoked_at, min(expires_at) AS expires_at FROM r GROUP BY 1)
SELECT u.id, f.jti IS NOT NULL AS revoked FROM v_users u LEFT JOIN (SELECT * FROM f WHERE expires_at >= {NOW} - INTERVAL '25' DAY) f ON f.jti = u.id""")
def str3(spark, d):
    events = table(spark, d, "events").where("event_type = 'error'").selectExpr("user_id AS jti", "ts AS revoked_at", "ts + INTERVAL '20' DAY AS expires_at")
    revoked = revoked_tokens(events, F.expr(f"{NOW} - INTERVAL '25' DAY")).select(F.col("jti").alias("id"), F.lit(True).alias("there"))
    return table(spark, d, "v_users").select("id").join(revoked, "id", "left").select("id", F.col("there").isNotNull().alias("revoked"))
