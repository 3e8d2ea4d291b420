"""URL filters: allow and block rules, and trust that flows over host edges.

A url's host is what follows its first ``://`` up to ``/``, ``?``, ``#`` or its
end, A-Z lower-cased; its path goes on up to ``?``, ``#`` or the end. A rule (host,
path, verdict) fits its host and all subdomains if the url's path starts with the
rule's; the longest wins (of equally long ones the longer host, then the greater
text).

Urls without a rule are judged by their host. Edges lead from a host to the hosts
that its pages link to (absolute and protocol-relative href attributes), and both
ways between a host and its registered domain. Every page is one unit of mass at
its host: trusted if a rule allows it, blocked if a rule blocks it, else neutral.
Trust and neutral mass walk along the edges, distrust walks against them, as
personalised PageRank: a round keeps DAMPING percent of the mass in motion and
gives the rest to the seeds again. A host is blocked if distrust is more than
THRESHOLD percent of what reaches it. Mass is counted in whole units and divided
without remainder, so results don't depend on the order of sums. Mass of a host
without edges stays out of the walk.

Everything is DataFrame functions. The edges of a host that is the source of a
thousandth of all edges or more (so at most a thousand hosts) are dealt over salts,
and its mass is sent to each of these; sums over targets and pages of a host are
combined before the shuffle. Each CUT rounds the masses are written to shared
storage.

Defined cases: a null url or one without ``://`` has an empty host and path, no
rule and no edges, and is allowed; a null html has no links; rows that repeat count
each; a null page_id is a row like others; an empty table gives no rows; other
columns aren't looked at. A page's html is one value of a row; its links are
extracted where it is read, and only distinct pairs of hosts are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import HOT_SHARE, joined_by_key, scratch, written

#: Rules of the query: (host, path, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Every row holds its url against all rules.
MAX_RULES = 1000
#: Whole units of mass of all pages; a page has an equal share.
MASS = 10**15
#: Percent of a round's mass that moves on along edges.
DAMPING = 70
ROUNDS = 10
#: Rounds between written masses.
CUT = 5
#: Percent of a host's mass that may be distrust.
THRESHOLD = 50
#: Second-level names under which two-letter country domains register.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
#: An absolute or protocol-relative link's host, in a form that Java and RE2 read alike.
LINK = r"""[hH][rR][eE][fF][ \t\n\r\f]*=[ \t\n\r\f]*["']?(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#"'<> \t\n\r\f]+)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_after_scheme(F.coalesce(url, F.lit(""))), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(F.coalesce(url, F.lit(""))), r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """The struct (rule, verdict) of the longest rule that fits, or null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules are more than {MAX_RULES}")
    if bad := [r for r in rules if r[2] not in ("allow", "block")]:
        raise ValueError(f"rules that neither allow nor block: {bad}")
    if not rules:
        return F.lit(None).cast("struct<rule: string, verdict: string>")
    listed = F.array(*[F.struct(F.lit(len(h + p)).alias("n"), F.lit(len(h)).alias("of_host"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"), F.lit(h).alias("h"), F.lit(p).alias("p")) for h, p, v in rules])
    fits = F.filter(listed, lambda r: ((host == r.h) | host.endswith(F.concat(F.lit("."), r.h))) & path.startswith(r.p))
    best = F.array_max(fits)
    return F.when(best.isNotNull(), F.struct(best.rule.alias("rule"), best.verdict.alias("verdict")))


def domain_of(host: Column) -> Column:
    """The registered domain: the last two names of a host, or three below a country's second level."""
    names = F.split(host, r"\.")
    n = F.size(names)
    country = (F.length(F.element_at(names, -1)) == 2) & (n >= 3) & F.get(names, n - 2).isin(*SECOND_LEVEL)
    return F.when(n <= 2, host).otherwise(F.array_join(F.slice(names, F.when(country, F.lit(-3)).otherwise(F.lit(-2)), 3), "."))


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst) distinct edges between different hosts."""
    html = F.coalesce("html", F.lit(""))
    links = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all(html, F.lit(LINK), 1)).alias("to"))
    links = links.select("src", F.translate("to", UPPER, LOWER).alias("dst")).where("src <> '' and dst <> src").distinct()
    hosts = pages.select(host_of(F.col("url")).alias("src")).where("src <> ''").distinct().unionByName(links.select(F.col("dst").alias("src"))).distinct()
    up = hosts.select("src", domain_of(F.col("src")).alias("dst")).where("dst <> src")
    down = up.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return links.unionByName(up).unionByName(down).distinct()


def walked(seeds: DataFrame, edges: DataFrame, rounds: int = ROUNDS, damping: int = DAMPING) -> DataFrame:
    """(host, kind, mass) after the walks from seeds (host, kind, mass); distrust goes against the edges.

    ``edges`` is read each round and should be a written table.
    """
    kinds = {"trust": ("src", "dst"), "neutral": ("src", "dst"), "distrust": ("dst", "src")}
    both = [edges.select(F.lit(k).alias("kind"), F.col(a).alias("host"), F.col(b).alias("to")) for k, (a, b) in kinds.items()]
    steps = both[0].unionByName(both[1]).unionByName(both[2])
    degrees = steps.groupBy("kind", "host").agg(F.count(F.lit(1)).alias("degree"))
    degrees = written(degrees, "url-degrees")
    total = degrees.agg(F.sum("degree")).first()[0] or 1
    # Edges of a host with many are dealt over as many salts as it has thousandths of all edges; all salts together are hosts and a thousand at most.
    salts = F.expr(f"degree * {HOT_SHARE} div {total} + 1").alias("salts")
    degrees = degrees.select("kind", "host", "degree", salts)
    steps = joined_by_key(steps, degrees, ["kind", "host"], "degree").select("kind", "host", F.pmod(F.xxhash64("to"), "salts").alias("salt"), "to")
    steps = written(steps, "url-steps")
    start = seeds.select("host", "kind", F.expr(f"mass * {100 - damping} div 100").alias("mass"))
    mass = seeds
    for done in range(1, rounds + 1):
        # What one edge of a host carries.
        sent = mass.join(degrees, ["kind", "host"]).select("kind", "host", F.expr(f"mass * {damping} div (100 * degree)").alias("mass"), "salts")
        sent = sent.select("kind", "host", "mass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
        moved = sent.join(steps, ["kind", "host", "salt"]).select(F.col("to").alias("host"), "kind", "mass")
        mass = moved.unionByName(start).groupBy("host", "kind").agg(F.sum("mass").alias("mass"))
        if done % CUT == 0 and done < rounds:
            mass = written(mass, "url-mass")
    return mass


def judged(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, threshold: int = THRESHOLD) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust, neutral) of every page; the last three are its host's mass."""
    spark = pages.sparkSession
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    rows = rows.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.col("found.verdict").alias("ruled"))
    with scratch(spark):
        kind = F.when(F.col("ruled") == "allow", "trust").when(F.col("ruled") == "block", "distrust").otherwise("neutral")
        counted = written(rows.groupBy("host", kind.alias("kind")).agg(F.count(F.lit(1)).alias("pages")), "url-seeds")
        total = counted.agg(F.sum("pages")).first()[0] or 1
        seeds = counted.where("host <> ''").select("host", "kind", (F.col("pages") * (MASS // total)).alias("mass"))
        mass = walked(seeds, written(host_edges(pages), "url-edges"))
        sizes = counted.select("host", F.lit(None).cast("string").alias("kind"), F.lit(0).cast("long").alias("mass"), "pages")
        every = mass.select("host", "kind", "mass", F.lit(0).cast("long").alias("pages")).unionByName(sizes)
        of = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("mass"))), F.lit(0).cast("long")).alias(k)
        hosts = every.groupBy("host").agg(of("trust"), of("distrust"), of("neutral"), F.sum("pages").alias("pages")).where("pages > 0")
        hosts = written(hosts, "url-hosts", kept=True)
    blocked = F.col("distrust") * 100 > threshold * (F.col("trust") + F.col("distrust") + F.col("neutral"))
    verdict = F.coalesce("ruled", F.when(blocked, "block").otherwise("allow")).alias("verdict")
    return joined_by_key(rows, hosts, ["host"], "pages").select("page_id", "host", "path", "rule", verdict, "trust", "distrust", "neutral")


def oracle(rules: tuple[tuple[str, str, str], ...] = RULES) -> str:
    """SQL of the same verdicts, one step of the walk after the other."""
    listed = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    second = ", ".join(f"'{x}'" for x in SECOND_LEVEL)
    link = LINK.replace("'", "''")
    lower = lambda x: f"translate({x}, '{UPPER}', '{LOWER}')"
    steps = []
    for i in range(1, ROUNDS + 1):
        steps.append(f"""
m{i} as materialized (
  select host, kind, cast(sum(mass) as bigint) as mass from (
    select s.goes as host, s.kind, m.mass * {DAMPING} // (100 * d.degree) as mass from m{i - 1} m join degrees d using (kind, host) join steps s using (kind, host)
    union all select host, kind, mass * {100 - DAMPING} // 100 from m0) group by host, kind)""")
    return rf"""
with p as materialized (
  select page_id, coalesce(html, '') as html, case when contains(coalesce(url, ''), '://') then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
u as materialized (select page_id, html, {lower("regexp_extract(rest, '^[^/?#]*')")} as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from p),
rules as (select * from (values {listed}) v(h, p, verdict)),
fits as (select host, path, arg_max(h || p, length(h || p)) as rule, arg_max(verdict, length(h || p)) as ruled
         from (select distinct host, path from u), rules where (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by host, path),
r as materialized (select page_id, host, path, rule, ruled from u left join fits using (host, path)),
seeds as materialized (select host, case ruled when 'allow' then 'trust' when 'block' then 'distrust' else 'neutral' end as kind, count(*) as n from r group by all),
m0 as materialized (select host, kind, cast(n * ({MASS} // (select sum(n) from seeds)) as bigint) as mass from seeds where host <> ''),
links as (select distinct host as src, {lower("goes")} as dst from (select host, unnest(regexp_extract_all(html, '{link}', 1)) as goes from u) where host <> '' and {lower("goes")} <> host),
names as (select host, string_split(host, '.') as n from (select host from u where host <> '' union select dst from links)),
up as (select host as src, case when len(n) <= 2 then host when length(n[-1]) = 2 and n[-2] in ({second}) then array_to_string(n[-3:], '.') else array_to_string(n[-2:], '.') end as dst from names),
edges as materialized (select src, dst from links union select src, dst from up where src <> dst union select dst, src from up where src <> dst),
steps as materialized (select 'trust' as kind, src as host, dst as goes from edges union all select 'neutral', src, dst from edges union all select 'distrust', dst, src from edges),
degrees as materialized (select kind, host, count(*) as degree from steps group by all),{",".join(steps)},
hosts as (select host, cast(coalesce(sum(mass) filter (where kind = 'trust'), 0) as bigint) as trust, cast(coalesce(sum(mass) filter (where kind = 'distrust'), 0) as bigint) as distrust,
                 cast(coalesce(sum(mass) filter (where kind = 'neutral'), 0) as bigint) as neutral from m{ROUNDS} group by host)
select page_id, host, path, rule, coalesce(ruled, case when distrust * 100 > {THRESHOLD} * (trust + distrust + neutral) then 'block' else 'allow' end) as verdict,
       coalesce(trust, 0) as trust, coalesce(distrust, 0) as distrust, coalesce(neutral, 0) as neutral
from r left join hosts using (host)
"""
