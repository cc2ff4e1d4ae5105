"""Sale-to-user record linkage without a shared id.

Shape of the job
----------------
* A score depends only on (e-mail, phone, name), so sales are reduced to distinct
  *buyer profiles* and users to distinct *user profiles* (keeping two member ids,
  enough to know whether the profile is ambiguous). A hot buyer is one row.
* Candidates come from equi joins on derived keys. Spelling neighbours are found
  on distinct texts, where the number of partners of one key is bounded by its
  length times the alphabet, and only then joined to profiles.
* The best and the second best candidate decide. Without a common phone a score depends
  on the two mailboxes and the two names: two users stand for all of one name that a
  mailbox reaches (`reached`), and are found for distinct mailboxes, not for buyers.
* A phone of few users is joined to them whole, as one array for each phone. On one of
  very many (a placeholder) again two users of a name stand for all, for each mailbox
  reached among them and without any (`best_two`).
* Evidence too weak to accept or to block (same core, same shared mailbox) is
  computed per (core, name) or (mailbox, name) group, never per pair of members; in a
  hot core or mailbox names meet under what they share (`name_pairs`).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnout.functions import keys as K
from turnout.functions.hashing import hash31
from turnout.operators.draws import dealt
from turnout.operators.ordered import running
from turnout.session import frozen, lookup, scratch, spread_small, stored


@dataclass(frozen=True)
class LinkConfig:
    """Weights, acceptance rule and propagation rule (fixed values of the scoring)."""

    w_email: float = 0.44
    w_phone: float = 0.36
    w_name: float = 0.20
    threshold: float = 0.52
    margin: float = 0.06
    same_mailbox: float = 0.85
    same_mailbox_shared: float = 0.45
    near_same_domain: float = 0.85
    near_other_domain: float = 0.65
    same_core: float = 0.25
    swapped_phone: float = 0.75
    propagate_from: float = 0.70
    propagate_factor: float = 0.85
    hot_block: int = 256

    def check(self) -> None:
        """The refinement of hot blocks and of weak evidence is exact only under these."""
        lone = max(self.w_email, self.w_phone)
        weak = self.w_email * max(self.same_core, self.same_mailbox_shared) + self.w_name
        if self.threshold - lone < self.margin or self.threshold - weak < self.margin:
            raise ValueError("weights let a lone key or weak evidence decide; no exact plan for them")


def normalise_sales(sales: DataFrame) -> DataFrame:
    """Sale id with its normalised keys and profile id."""
    cleaned = sales.select(
        "sale_id",
        K.email_text(F.col("buyer_email")).alias("text"),
        K.norm_phone(F.col("buyer_phone")).alias("phone"),
        K.name_set(F.col("buyer_name")).alias("names"),
    )
    return _email_columns(cleaned, "sale_id", "phone", "names").withColumn(
        "pid", F.unhex(F.md5(F.concat_ws("\u0001", "email", "phone", F.array_join("names", " "))))
    )


def normalise_users(users: DataFrame) -> DataFrame:
    cleaned = users.select(
        "user_id",
        K.email_text(F.col("email")).alias("text"),
        K.norm_phone(F.col("phone")).alias("phone"),
        K.name_set(F.concat_ws(" ", F.coalesce("first_name", F.lit("")), F.coalesce("last_name", F.lit("")))).alias("names"),
    )
    return _email_columns(cleaned, "user_id", "phone", "names")


def _email_columns(df: DataFrame, *keep: str) -> DataFrame:
    parts = df.select(
        *keep, K.email_local(F.col("text")).alias("local"), K.email_domain(F.col("text")).alias("dom"), "text"
    )
    return parts.select(
        *keep,
        F.when(F.col("text").contains("@"), F.concat_ws("@", "local", "dom")).otherwise(F.col("text")).alias("email"),
        "local",
        "dom",
        K.local_core(F.col("local")).alias("core"),
    )


def email_evidence(s_email, s_local, s_dom, s_core, u_email, u_local, u_dom, u_core, u_alone: Column,
                   cfg: LinkConfig) -> Column:
    return (
        F.when((s_email != "") & (s_email == u_email), F.lit(1.0))
        .when(
            (s_local != "") & (s_local == u_local),
            F.when(s_local.rlike("[0-9]") | u_alone, F.lit(cfg.same_mailbox)).otherwise(
                F.lit(cfg.same_mailbox_shared)
            ),
        )
        .when(
            (s_local != "") & (u_local != "") & (F.levenshtein(s_local, u_local, 1) >= 0),
            F.when((s_dom != "") & (s_dom == u_dom), F.lit(cfg.near_same_domain)).otherwise(
                F.lit(cfg.near_other_domain)
            ),
        )
        .when((s_core != "") & (s_core == u_core), F.lit(cfg.same_core))
        .otherwise(F.lit(0.0))
    )


def phone_evidence(s_phone: Column, u_phone: Column, cfg: LinkConfig) -> Column:
    return (
        F.when((s_phone == "") | (u_phone == ""), F.lit(0.0))
        .when(s_phone == u_phone, F.lit(1.0))
        # a swap is at most two edits; the exact test is left for those
        .when(
            (F.levenshtein(s_phone, u_phone, 2) >= 0)
            & F.array_contains(K.adjacent_swaps(u_phone), s_phone),
            F.lit(cfg.swapped_phone),
        )
        .otherwise(F.lit(0.0))
    )


def score(e: Column, p: Column, n: Column, cfg: LinkConfig) -> Column:
    return F.least(F.lit(cfg.w_email) * e + F.lit(cfg.w_phone) * p + F.lit(cfg.w_name) * n, F.lit(1.0))


def buyer_profiles(sales_norm: DataFrame) -> DataFrame:
    """Distinct buyers; `first_sale` is the smallest sale id behind each."""
    return sales_norm.groupBy("pid", "email", "local", "dom", "core", "phone", "names").agg(
        F.min("sale_id").alias("first_sale"), F.count(F.lit(1)).alias("n_sales")
    )


def user_profiles(users_norm: DataFrame) -> DataFrame:
    """Distinct users with their largest and smallest id, and whether the mailbox is unique."""
    profiles = users_norm.groupBy("email", "local", "dom", "core", "phone", "names").agg(
        F.max("user_id").alias("uid"), F.min("user_id").alias("uid_low"), F.count(F.lit(1)).alias("n_users")
    )
    per_local = profiles.groupBy("local").agg((F.sum("n_users") == 1).alias("alone"))
    return profiles.join(per_local, "local")


def neighbours(left: DataFrame, right: DataFrame, col: str, carry: str | None = None) -> DataFrame:
    """Pairs of distinct texts that share a member of {text} and its one-letter deletions.

    `carry` is a column determined by the text that travels along.
    """
    extra = [carry] if carry else []

    def exploded(df, side):
        texts = df.filter(F.col(col) != "").select(col, *extra).distinct()
        return texts.select(
            *[F.col(c).alias(f"{side}_{c}") for c in (col, *extra)],
            F.explode(F.concat(F.array(col), K.deletions(F.col(col)))).alias("key"),
        )

    return exploded(left, "s").join(exploded(right, "u"), "key").drop("key")


def core_neighbours(profiles: DataFrame, users: DataFrame) -> DataFrame:
    return neighbours(profiles, users, "core").distinct()


def _near_mailboxes(profiles: DataFrame, users: DataFrame) -> DataFrame:
    """Mailboxes exactly one edit apart: s_local, u_local, and whether their cores are neighbours too."""

    def around(c):
        return F.concat(F.array(c), K.deletions(F.col(c)))

    pairs = neighbours(profiles, users, "local", carry="core")
    # one edit apart implies neighbourhood; the array test is left for the rest
    cores_near = (
        F.when((F.col("s_core") == "") | (F.col("u_core") == ""), F.lit(False))
        .when(F.levenshtein("s_core", "u_core", 1) >= 0, F.lit(True))
        .otherwise(F.arrays_overlap(around("s_core"), around("u_core")))
    )
    return (
        pairs.filter(F.col("s_local") != F.col("u_local"))
        .filter(F.levenshtein("s_local", "u_local", 1) >= 0)
        .select("s_local", "u_local", cores_near.alias("cores_near"))
        .distinct()
    )


def _tag(kind: str, c: Column) -> Column:
    return F.concat(F.lit(kind), c)


def _no_keys() -> Column:
    return F.array().cast("array<string>")


def strong_pairs(profiles: DataFrame, users: DataFrame) -> DataFrame:
    """All profile pairs sharing an e-mail, an identifying mailbox, a near mailbox or a phone.

    A pair that shares several keys appears once for each. For counts: `candidates` forms
    only those that can decide.
    """
    identifying = F.col("local").rlike("[0-9]") | F.col("alone")
    u_keys = users.withColumn(
        "key",
        F.explode(
            F.concat(
                F.when(F.col("email") != "", F.array(_tag("e", F.col("email")))).otherwise(_no_keys()),
                F.when(F.col("local") != "", F.array(_tag("n", F.col("local")))).otherwise(_no_keys()),
                F.when((F.col("local") != "") & identifying, F.array(_tag("l", F.col("local")))).otherwise(_no_keys()),
                F.when(F.col("phone") != "", F.array(_tag("p", F.col("phone")))).otherwise(_no_keys()),
            )
        ),
    )
    own_keys = profiles.withColumn(
        "key",
        F.explode(
            F.concat(
                F.when(F.col("email") != "", F.array(_tag("e", F.col("email")))).otherwise(_no_keys()),
                F.when(F.col("local") != "", F.array(_tag("l", F.col("local")))).otherwise(_no_keys()),
                F.when(
                    F.col("phone") != "",
                    F.transform(
                        F.concat(F.array("phone"), K.adjacent_swaps(F.col("phone"))), lambda t: _tag("p", t)
                    ),
                ).otherwise(_no_keys()),
            )
        ),
    )
    near = _near_mailboxes(profiles, users).filter("cores_near").select(
        F.col("s_local").alias("local"), _tag("n", F.col("u_local")).alias("key")
    )
    s_keys = own_keys.unionByName(profiles.join(near, "local").select(*own_keys.columns))
    s_cols = ["pid", *[F.col(c).alias(f"s_{c}") for c in _SIDE]]
    u_cols = ["uid", "uid_low", *[F.col(c).alias(f"u_{c}") for c in _SIDE], F.col("alone").alias("u_alone")]
    return s_keys.select("key", *s_cols).join(u_keys.select("key", *u_cols), "key").drop("key")


_SIDE = ["email", "local", "dom", "core", "phone", "names"]


def scored_strong(pairs: DataFrame, cfg: LinkConfig) -> DataFrame:
    c = F.col
    ev = pairs.select(
        "pid",
        "uid",
        "uid_low",
        email_evidence(
            c("s_email"), c("s_local"), c("s_dom"), c("s_core"),
            c("u_email"), c("u_local"), c("u_dom"), c("u_core"), c("u_alone"), cfg,
        ).alias("e"),
        phone_evidence(c("s_phone"), c("u_phone"), cfg).alias("p"),
        K.name_similarity(c("s_names"), c("u_names")).alias("n"),
    )
    return ev.withColumn("score", score(c("e"), c("p"), c("n"), cfg))


def name_pairs(sales: DataFrame, users: DataFrame, meets: DataFrame, cfg: LinkConfig) -> DataFrame:
    """Pairs of names among which the best of every (s_key, s_names) is: s_key, s_names, e, u_names, uid.

    `sales` has s_key, s_names; `users` has u_key, u_names, uid; `meets` says which keys meet, with
    their evidence e. A key of few users is joined whole. Below a hot one a pair's
    similarity depends on the tokens of the two names that match, and on their numbers:

    * pairs that match in nothing score alike, so the user with the largest id stands for all;
    * others meet under a token, one an edit away or an initial. Where that is hot in turn,
      one user for each number of tokens stands for those that match in nothing else, and
      those that match in two hot tokens meet under both.

    So what is joined grows with the names of a key, not with their product.
    """
    sides = sales.join(meets, "s_key")
    sizes = users.groupBy("u_key").agg(F.count(F.lit(1)).alias("n"))
    hot = sizes.filter(F.col("n") > cfg.hot_block).select("u_key")
    whole = sides.join(users.join(hot, "u_key", "left_anti"), "u_key")
    hot_users, hot_sides = users.join(hot, "u_key", "left_semi"), sides.join(hot, "u_key", "left_semi")
    largest = F.max(F.struct("uid", "u_names")).alias("one")
    alone = hot_sides.join(hot_users.groupBy("u_key").agg(largest), "u_key").select("s_key", "s_names", "e", "one.*")

    u_sub = hot_users.withColumn("k", F.explode(K.name_block_keys(F.col("u_names"), "user"))).select("u_key", "u_names", "uid", "k.sub", "k.tok")
    s_sub = hot_sides.withColumn("k", F.explode(K.name_block_keys(F.col("s_names"), "sale"))).select("s_key", "s_names", "u_key", "e", "k.sub", "k.tok")
    busy = u_sub.groupBy("u_key", "sub").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > cfg.hot_block).select("u_key", "sub")
    under = s_sub.drop("tok").join(u_sub.join(busy, ["u_key", "sub"], "left_anti").drop("tok"), ["u_key", "sub"])

    busy_u, busy_s = (x.join(busy, ["u_key", "sub"], "left_semi") for x in (u_sub, s_sub))
    # under a deletion stand several tokens, which match a sale's token in different ways
    kind = F.when(F.col("sub").startswith("d:"), F.col("tok")).otherwise("")
    stand = busy_u.groupBy("u_key", "sub", kind.alias("kind"), F.size("u_names").alias("size")).agg(largest)
    one = busy_s.select("s_key", "s_names", "u_key", "e", "sub").join(stand, ["u_key", "sub"]).select("s_key", "s_names", "e", "one.*")

    def twos(df: DataFrame, owner: list[str], apart: bool) -> DataFrame:
        """A row for every two busy keys of a name; of a user's they come from different tokens, which one of a sale may match."""
        subs = df.groupBy(*owner).agg(F.collect_set(F.struct("sub", "tok")).alias("subs"))
        fits = lambda x, y: (x["sub"] <= y["sub"]) & ((x["tok"] != y["tok"]) if apart else F.lit(True))
        pairs = F.flatten(F.transform("subs", lambda x: F.transform(F.filter("subs", lambda y: fits(x, y)), lambda y: F.concat_ws("|", x["sub"], y["sub"]))))
        return subs.select(*owner, F.explode(F.array_distinct(pairs)).alias("two"))

    both = twos(busy_s, ["s_key", "s_names", "u_key", "e"], False).join(twos(busy_u, ["u_key", "u_names", "uid"], True), ["u_key", "two"])
    cols = ["s_key", "s_names", "e", "u_names", "uid"]
    out = whole.select(cols)
    for part in (alone, under, one, both):
        out = out.unionByName(part.select(cols))
    return out


def weak_best(profiles: DataFrame, users: DataFrame, cfg: LinkConfig) -> DataFrame:
    """Best candidate per (email, names) among those sharing only a core or a shared mailbox."""

    def pick(sales: DataFrame, known: DataFrame, meets: DataFrame) -> DataFrame:
        scored = name_pairs(sales, known, meets, cfg).withColumn("n", K.name_similarity(F.col("s_names"), F.col("u_names")))
        total = score(F.col("e"), F.lit(0.0), F.col("n"), cfg).alias("score")
        return scored.groupBy("s_key", "s_names").agg(F.max(F.struct(total, "uid", "e", F.lit(0.0).alias("p"), "n")).alias("weak"))

    def named(df: DataFrame, key: str, prefix: str) -> DataFrame:
        return df.select(F.col(key).alias(f"{prefix}_key"), F.col("names").alias(f"{prefix}_names"), *(["uid"] if prefix == "u" else []))

    def largest(df: DataFrame) -> DataFrame:
        return df.groupBy("u_key", "u_names").agg(F.max("uid").alias("uid"))

    with_core = F.col("core") != ""
    near = core_neighbours(profiles, users).select(
        F.col("s_core").alias("s_key"), F.col("u_core").alias("u_key"),
        F.when(F.col("s_core") == F.col("u_core"), F.lit(cfg.same_core)).otherwise(F.lit(0.0)).alias("e"),
    )
    by_core = pick(named(profiles.filter(with_core), "core", "s").distinct(), largest(named(users.filter(with_core), "core", "u")), near)

    plain = ~F.col("local").rlike("[0-9]") & (F.col("local") != "")
    boxes = largest(named(users.filter(plain & ~F.col("alone")), "local", "u"))
    own = boxes.select(F.col("u_key").alias("s_key"), "u_key", F.lit(cfg.same_mailbox_shared).alias("e")).distinct()
    by_box = pick(named(profiles.filter(plain), "local", "s").distinct(), boxes, own)

    base = lambda key: profiles.select("email", F.col(key).alias("s_key"), F.col("names").alias("s_names")).distinct()
    a = base("core").join(by_core, ["s_key", "s_names"])
    b = base("local").join(by_box, ["s_key", "s_names"])
    return a.unionByName(b).select("email", F.col("s_names").alias("names"), "weak.*")


def first_two(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first two rows of every group."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("place", place).filter("place <= 2").drop("place")


def reached(asked: DataFrame, known: DataFrame, near: DataFrame, cfg: LinkConfig) -> DataFrame:
    """The two users of every name with the best e-mail evidence: crowd, email, u_names, uid, e.

    `asked` has the buyers' distinct crowd, email, local, dom, core; `known` the users' crowd,
    email, local, dom, core, alone, names, uid. Users are met in their own crowd only; the empty
    one holds everyone, and there weak evidence is left to `weak_best`. `near` is `_near_mailboxes`.

    For one mailbox and one user name the rest of a score is the same, so whoever has two such
    users before it, by evidence and then by id, is neither best nor second best. A user may
    also be met under less evidence than it has; that never lifts it over another.
    """
    crowded = F.col("crowd") != ""

    def two(df: DataFrame, *keys: str) -> DataFrame:
        best = first_two(df.select("crowd", *keys, F.col("names").alias("u_names"), "uid"), ["crowd", *keys, "u_names"], F.desc("uid"))
        return best

    def met(pairs: DataFrame, e: Column) -> DataFrame:
        return pairs.select("crowd", "email", "u_names", "uid", e.alias("e"))

    boxes = known.filter(F.col("local") != "")
    own_e = F.when(F.col("local").rlike("[0-9]") | F.col("alone"), F.lit(cfg.same_mailbox)).otherwise(F.lit(cfg.same_mailbox_shared))
    by_local, alone = two(boxes, "local"), boxes.select("local", "alone").distinct()
    own = asked.select("crowd", "email", "local").join(by_local, ["crowd", "local"]).join(alone, "local")
    own = own.filter(crowded | F.col("local").rlike("[0-9]") | F.col("alone"))
    # another mailbox's users are gathered for the mailbox before its domains
    close = near.filter("cores_near").select("s_local", "u_local")
    steps = lambda df: df.filter(~crowded).join(close, F.col("local") == F.col("s_local")).unionByName(
        df.filter(crowded).join(near.drop("cores_near"), F.col("local") == F.col("s_local"))).drop("s_local")
    beside = steps(asked.select("crowd", "local").distinct()).join(by_local.withColumnRenamed("local", "u_local"), ["crowd", "u_local"])
    beside = first_two(beside.select("crowd", "local", "u_names", "uid").distinct(), ["crowd", "local", "u_names"], F.desc("uid"))
    other = asked.select("crowd", "email", "local").join(beside, ["crowd", "local"])
    in_dom = steps(asked.filter(F.col("dom") != "").select("crowd", "email", "local", "dom")).join(
        two(boxes, "local", "dom").withColumnRenamed("local", "u_local"), ["crowd", "u_local", "dom"])
    with_core = F.col("core") != ""
    alike = asked.filter(crowded & with_core).select("crowd", "email", "core").join(
        two(known.filter(crowded & with_core), "core"), ["crowd", "core"])
    equal = asked.filter(F.col("email") != "").select("crowd", "email").join(two(known.filter(F.col("email") != ""), "email"), ["crowd", "email"])
    every = met(equal, F.lit(1.0))
    for part, e in ((own, own_e), (in_dom, F.lit(cfg.near_same_domain)), (other, F.lit(cfg.near_other_domain)), (alike, F.lit(cfg.same_core))):
        every = every.unionByName(met(part, e))
    keys = ["crowd", "email", "u_names"]
    best = every.repartition("crowd", "email").groupBy(*keys, "uid").agg(F.max("e").alias("e"))
    return first_two(best, keys, F.desc("e"), F.desc("uid"))


def best_two(sides: DataFrame, offers: DataFrame, on: list[str], cfg: LinkConfig) -> DataFrame:
    """The two best of the users offered to every name: *on, names, uid, e, n.

    `sides` has distinct *on, names; `offers` has *on, u_names, uid, e. Where very many are
    offered they meet a name under a token both have (or one an edit away, or an initial),
    and the two with the most evidence stand for those that match in nothing.
    """
    sizes = offers.groupBy(*on).agg(F.count(F.lit(1)).alias("size"))
    hot = sizes.filter(F.col("size") > cfg.hot_block).select(*on)
    few = sides.join(offers.join(hot, on, "left_anti"), on)
    many = offers.join(hot, on, "left_semi")
    keyed = lambda df, names, side: df.withColumn("k", F.explode(K.name_block_keys(F.col(names), side))).withColumns(
        {"sub": F.col("k.sub"), f"{side}_tok": F.col("k.tok")}).drop("k")
    # equal tokens meet under "t:" only, so "d:" keeps the pairs exactly one edit apart
    one_edit = (F.col("sale_tok") != F.col("user_tok")) & (F.levenshtein("sale_tok", "user_tok", 1) >= 0)
    under = keyed(sides.join(hot, on, "left_semi"), "names", "sale").join(keyed(many, "u_names", "user"), [*on, "sub"])
    under = under.filter(~F.col("sub").startswith("d:") | one_edit)
    stand = sides.join(first_two(many, on, F.desc("e"), F.desc("uid")), on)
    cols = [*on, "names", "u_names", "uid", "e"]
    met = few.select(cols).unionByName(under.select(cols)).unionByName(stand.select(cols))
    scored = met.select(*on, "names", "uid", "e", K.name_similarity(F.col("names"), F.col("u_names")).alias("n"))
    keys = [*on, "names"]
    once = scored.repartition(*keys).groupBy(*keys, "uid").agg(F.max("e").alias("e"), F.max("n").alias("n"))
    return first_two(once, keys, F.desc(score(F.col("e"), F.lit(0.0), F.col("n"), cfg)), F.desc("uid"))


def _found(uid: Column, e: Column, p: Column, n: Column, cfg: LinkConfig) -> Column:
    """A candidate, in the order in which candidates are compared."""
    return F.struct(score(e, p, n, cfg).alias("score"), uid.alias("uid"), e.alias("e"), p.alias("p"), n.alias("n"))


def phone_meets(profiles: DataFrame, users: DataFrame, cfg: LinkConfig) -> DataFrame:
    """Buyers' and users' phones that agree or differ by a swap, on distinct phones: phone, u_phone, p."""
    theirs = users.filter(F.col("phone") != "").select(F.col("phone").alias("u_phone")).distinct()
    # exchanging two neighbours undoes itself, so the users' side, which is the smaller, may be varied
    around = F.concat(F.array("u_phone"), K.adjacent_swaps(F.col("u_phone")))
    varied = theirs.select("u_phone", F.explode(around).alias("phone"))
    ours = profiles.filter(F.col("phone") != "").select("phone").distinct()
    p = F.when(F.col("phone") == F.col("u_phone"), F.lit(1.0)).otherwise(F.lit(cfg.swapped_phone))
    return ours.join(varied, "phone").select("phone", "u_phone", p.alias("p"))


def _phone_users(meets: DataFrame, users: DataFrame) -> DataFrame:
    """(phone, known): all users behind the phones that few users have."""
    cols = [F.col(c) for c in ("uid", "uid_low", *_SIDE, "alone")]
    side = users.select(F.col("phone").alias("u_phone"), F.struct(*cols).alias("user"))
    return meets.join(side, "u_phone").groupBy("phone").agg(F.collect_list(F.struct("p", "user")).alias("known"))


def _phone_found(cfg: LinkConfig) -> Column:
    """The candidates of a profile among `known`, of which the two best matter."""
    c = F.col

    def one(x: Column) -> Column:
        u = x["user"]
        e = email_evidence(c("email"), c("local"), c("dom"), c("core"), u["email"], u["local"], u["dom"], u["core"], u["alone"], cfg)
        return F.struct(u["uid"].alias("uid"), u["uid_low"].alias("uid_low"), e.alias("e"), x["p"].alias("p"),
                        K.name_similarity(c("names"), u["names"]).alias("n"))

    rows = F.transform(F.transform("known", one), lambda x: F.array(
        _found(x["uid"], x["e"], x["p"], x["n"], cfg), _found(x["uid_low"], x["e"], x["p"], x["n"], cfg)))
    return F.slice(F.sort_array(F.array_distinct(F.flatten(rows)), asc=False), 1, 2)


def _no_found() -> Column:
    return F.array().cast("array<struct<score:double,uid:bigint,e:double,p:double,n:double>>")


def candidates(profiles: DataFrame, users: DataFrame, cfg: LinkConfig) -> DataFrame:
    """Profiles with `found`: candidates as (score, uid, e, p, n), the two best among them."""
    meets = stored(phone_meets(profiles, users, cfg))
    near = stored(_near_mailboxes(profiles, users))
    sizes = users.groupBy(F.col("phone").alias("u_phone")).agg(F.count(F.lit(1)).alias("size"))
    hot = lookup(stored(sizes.filter((F.col("u_phone") != "") & (F.col("size") > cfg.hot_block)).select("u_phone")))
    busy = stored(meets.join(hot, "u_phone"))  # (phone, u_phone, p) of placeholders
    in_crowd = lookup(busy.select("phone").distinct().withColumn("busy", F.lit(True)))

    # a crowd is everyone (""), or those on one busy phone
    mailbox = ["email", "local", "dom", "core"]
    crowd_of = lambda df: df.join(lookup(busy), "phone").withColumn("crowd", F.col("u_phone"))
    everyone = profiles.withColumn("crowd", F.lit(""))
    people = users.withColumn("uid", F.explode(F.array_distinct(F.array("uid", "uid_low"))))
    u_cols = ["crowd", *mailbox, "alone", "names", "uid"]
    on_busy = people.join(hot.withColumnRenamed("u_phone", "phone"), "phone").withColumn("crowd", F.col("phone"))
    known = people.withColumn("crowd", F.lit("")).select(u_cols).unionByName(on_busy.select(u_cols))
    s_cols = ["crowd", *mailbox, "names"]
    sides = stored(everyone.filter(F.col("email") != "").select(s_cols).unionByName(crowd_of(profiles).select(s_cols)).distinct())
    offers = stored(reached(sides.drop("names").distinct(), known, near, cfg))
    boxed = stored(best_two(sides.select("crowd", "email", "names"), offers, ["crowd", "email"], cfg))

    # placeholders: those reached by mailbox, and the two best names of the crowd without one
    two_of_name = first_two(on_busy.select("crowd", F.col("names").alias("u_names"), "uid"), ["crowd", "u_names"], F.desc("uid"))
    named = best_two(crowd_of(profiles).select("crowd", "names").distinct(), two_of_name.withColumn("e", F.lit(0.0)), ["crowd"], cfg)
    asked = crowd_of(profiles.select("phone", "email", "names").distinct())
    took = _found(F.col("uid"), F.col("e"), F.col("p"), F.col("n"), cfg)
    crowd_cols = ["phone", "email", "names", took.alias("x")]
    crowded = asked.join(boxed, ["crowd", "email", "names"]).select(crowd_cols).unionByName(
        asked.join(named, ["crowd", "names"]).select(crowd_cols))
    crowded = crowded.groupBy("phone", "email", "names").agg(F.collect_list("x").alias("of_crowd"))

    # by mailbox alone
    alone = boxed.filter("crowd = ''").select("email", "names", _found(F.col("uid"), F.col("e"), F.lit(0.0), F.col("n"), cfg).alias("x"))
    weak = weak_best(profiles, users, cfg).select("email", "names", F.struct("score", "uid", "e", "p", "n").alias("x"))
    by_box = stored(alone.unionByName(weak).groupBy("email", "names").agg(F.collect_list("x").alias("of_box")))

    few = _phone_users(meets.join(hot, "u_phone", "left_anti"), users)
    keep = ["pid", "email", "names", "first_sale"]
    silent = profiles.filter(F.col("phone") == "").select(*keep, _no_found().alias("of_phone"))
    calling = profiles.filter(F.col("phone") != "").join(in_crowd, "phone", "left")
    of_phone = F.coalesce(_phone_found(cfg), _no_found())
    plain = calling.filter("busy is null").join(few, "phone", "left").select(*keep, of_phone.alias("of_phone"))
    with_crowd = calling.filter("busy").join(few, "phone", "left").join(crowded, ["phone", "email", "names"], "left").select(
        *keep, F.concat(of_phone, F.coalesce("of_crowd", _no_found())).alias("of_phone"))
    every = silent.unionByName(plain).unionByName(with_crowd).join(by_box, ["email", "names"], "left")
    return every.select("pid", "email", "first_sale", F.concat("of_phone", F.coalesce("of_box", _no_found())).alias("found"))


def decide(cands: DataFrame, cfg: LinkConfig) -> DataFrame:
    """Per buyer: the best candidate, accepted if above the threshold and clear of the second."""
    ranked = cands.withColumn("found", F.sort_array("found", asc=False)).withColumn("best", F.try_element_at("found", F.lit(1)))
    rivals = F.filter("found", lambda x: x["uid"] != F.col("best.uid"))
    second = F.coalesce(F.try_element_at(rivals, F.lit(1))["score"], F.lit(0.0))
    ok = F.coalesce(
        (F.col("best.score") >= cfg.threshold) & (F.col("best.score") - second >= cfg.margin),
        F.lit(False),
    )
    return ranked.select(
        "pid",
        "email",
        "first_sale",
        F.when(ok, F.col("best.uid")).alias("user_id"),
        F.when(ok, F.bround("best.score", 4)).otherwise(F.lit(0.0)).alias("confidence"),
        F.coalesce(F.bround("best.e", 2), F.lit(0.0)).alias("ev_email"),
        F.coalesce(F.bround("best.p", 2), F.lit(0.0)).alias("ev_phone"),
        F.coalesce(F.bround("best.n", 2), F.lit(0.0)).alias("ev_name"),
        F.when(ok, F.lit("directo")).otherwise(F.lit("")).alias("via"),
    )


def propagate(decided: DataFrame, cfg: LinkConfig) -> DataFrame:
    """Give unmatched buyers the firmest direct match of the same e-mail."""
    firm = (
        decided.filter((F.col("via") == "directo") & (F.col("email") != ""))
        .groupBy("email")
        .agg(F.min_by(F.struct("user_id", "confidence"), F.struct(-F.col("confidence"), F.col("first_sale"))).alias("hit"))
        .filter(F.col("hit.confidence") >= cfg.propagate_from)
    )
    joined = decided.join(firm, "email", "left")
    take = F.col("user_id").isNull() & F.col("hit").isNotNull()
    return joined.select(
        "pid",
        F.when(take, F.col("hit.user_id")).otherwise(F.col("user_id")).alias("user_id"),
        F.when(take, F.bround(F.col("hit.confidence") * cfg.propagate_factor, 4))
        .otherwise(F.col("confidence"))
        .alias("confidence"),
        "ev_email",
        "ev_phone",
        "ev_name",
        F.when(take, F.lit("propagado")).otherwise(F.col("via")).alias("via"),
    )


def link(sales: DataFrame, users: DataFrame, cfg: LinkConfig | None = None) -> DataFrame:
    """Linkage with evidence: one row per sale; `user_id` is NULL without a match."""
    cfg = cfg or LinkConfig()
    cfg.check()
    with scratch(sales.sparkSession):
        # both sides feed many joins: normalise once, and keep filters out of the expressions
        s = stored(normalise_sales(spread_small(sales)))
        profiles = stored(buyer_profiles(s))
        u = stored(user_profiles(normalise_users(spread_small(users))))
        # propagation reads the decisions twice
        decided = stored(decide(candidates(profiles, u, cfg), cfg))
        result = propagate(decided, cfg)
        return stored(s.select("sale_id", "pid").join(result, "pid").drop("pid"), keep=True)


def coverage(links: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    matched = F.count("user_id")
    return links.agg(
        n.alias("n_sales"),
        matched.alias("n_matched"),
        F.round(matched / n, 6).alias("share_matched"),
        F.count_if(F.col("via") == "propagado").alias("n_propagated"),
    )


def evidence_audit(links: DataFrame) -> DataFrame:
    """What the accepted matches rest on."""
    direct = links.filter(F.col("via") == "directo")
    email, phone, name = F.col("ev_email") == 1.0, F.col("ev_phone") == 1.0, F.col("ev_name") >= 0.9

    def share(cond):
        return F.round(F.avg(cond.cast("double")), 6)

    return direct.agg(
        F.count(F.lit(1)).alias("n_direct"),
        share(email).alias("share_email"),
        share(phone).alias("share_phone"),
        share(email & phone).alias("share_both"),
        share(email | phone).alias("share_any"),
        share(name).alias("share_name"),
    )


def block_sizes(sales: DataFrame, users: DataFrame) -> DataFrame:
    """Per key kind: distinct shared keys and the pairs a plain block join would emit.

    The pairs are counted as products of group sizes; none is formed.
    """
    s, u = frozen(normalise_sales(sales)), frozen(normalise_users(users))
    out = None
    for kind in ("email", "local", "core", "phone"):
        a = s.filter(F.col(kind) != "").groupBy(F.col(kind).alias("key")).agg(F.count(F.lit(1)).alias("ns"))
        b = u.filter(F.col(kind) != "").groupBy(F.col(kind).alias("key")).agg(F.count(F.lit(1)).alias("nu"))
        one = a.join(b, "key").agg(
            F.count(F.lit(1)).alias("n_keys"),
            F.coalesce(F.sum(F.col("ns") * F.col("nu")), F.lit(0)).alias("n_pairs"),
            F.coalesce(F.max("nu"), F.lit(0)).alias("largest_user_block"),
        ).select(F.lit(kind).alias("kind"), "n_keys", "n_pairs", "largest_user_block")
        out = one if out is None else out.unionByName(one)
    return out


def key_quality(sales: DataFrame, users: DataFrame) -> DataFrame:
    """How dirty the keys are: unknown domains, blank phones, repeated user names."""
    s = sales.select(
        K.email_text(F.col("buyer_email")).alias("text"), K.norm_phone(F.col("buyer_phone")).alias("phone")
    )
    raw_dom = F.substring_index("text", "@", -1)
    has_at = F.col("text").contains("@")
    sale_side = s.agg(
        F.count_if(has_at & ~raw_dom.isin(K.KNOWN_DOMAINS)).alias("sales_unknown_domain"),
        F.count_if(has_at & ~raw_dom.isin(K.KNOWN_DOMAINS) & K.fix_domain(raw_dom).isin(K.KNOWN_DOMAINS)).alias("sales_repaired_domain"),
        F.count_if(F.col("phone") == "").alias("sales_blank_phone"),
    )
    names = users.groupBy(K.name_key(F.concat_ws(" ", "first_name", "last_name")).alias("name_key")).count()
    user_side = names.agg(
        F.count_if(F.col("count") > 1).alias("names_repeated"),
        F.count_if(F.col("count") > 3).alias("names_over_three"),
    )
    return sale_side.select(
        "*", *[user_side.select(c).scalar().alias(c) for c in ("names_repeated", "names_over_three")]
    )


def permutation_gap(linked: DataFrame, label: str, rate: str, reps: int, seed: int, low: float, high: float) -> DataFrame:
    """Permutation test of the history signal: attendance gap between high and low rates.

    Each replicate pairs the labels with the rates of another row: the rates stay in the order of
    the ticket ids, the labels come in a hashed order of the replicate's own. Tickets are ranked
    once and packed, by five bytes each; a task holds them packed and deals replicate after
    replicate, so no replicate of a ticket becomes a row. One row per replicate, replicate 0
    being the observed pairing; the gap is null where one of the sides has no rows.
    """
    spark = linked.sparkSession
    base = linked.filter(F.col(rate).isNotNull() & F.col(label).isNotNull()).select(
        "ticket_id", F.col(label).cast("boolean").alias("y"), (F.col(rate) > high).alias("high"), (F.col(rate) <= low).alias("low"))
    ranked = running(base, [F.col("ticket_id").asc_nulls_last()], rank="k")
    row = F.struct("k", hash31(F.col("ticket_id")).alias("h"), "y", "high", "low")
    block = F.floor((F.col("k") - 1) / F.lit(_PACKED)).cast("int").alias("block")
    blocks = stored(ranked.groupBy(block).agg(F.collect_list(row).alias("rows")).mapInArrow(_packed, "block int, h binary, kinds binary"))
    tasks = min(reps + 1, 2 * spark.sparkContext.defaultParallelism)
    shared = blocks.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            for task, h, kinds in zip(b.column("task").to_pylist(), b.column("h"), b.column("kinds"), strict=True):
                held.setdefault(task, []).append((np.frombuffer(h.as_py(), np.uint32), np.frombuffer(kinds.as_py(), np.uint8)))
        for task in list(held):
            h, kinds = (np.concatenate(x) for x in zip(*held.pop(task), strict=True))
            y, of = (kinds & 1).astype(bool), [(kinds & 2).astype(bool), (kinds & 4).astype(bool)]
            sizes = [int(np.count_nonzero(x)) for x in of]
            for rep in range(task, reps + 1, tasks):
                got = dealt(seed, rep, h, y, of) if rep else [int(np.count_nonzero(y & x)) for x in of]
                gap = got[0] / sizes[0] - got[1] / sizes[1] if all(sizes) else None
                yield pa.RecordBatch.from_arrays([pa.array([rep], pa.int64()), pa.array([gap], pa.float64())], ["rep", "gap"])

    placed = shared.repartitionById(tasks, F.col("task")).sortWithinPartitions("task", "block")
    return placed.mapInArrow(run, "rep long, gap double").select("rep", F.round("gap", 9).alias("gap"))


_PACKED = 65_536  # tickets of a packed block


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tickets of a block in order: their hashes, and label, high and low as bits."""
    for b in batches:
        for i in range(b.num_rows):
            rows = b.column(1).slice(i, 1).flatten()
            order = np.argsort(rows.field(0).to_numpy())
            bits = [rows.field(j).to_numpy(zero_copy_only=False).astype(np.uint8) for j in (2, 3, 4)]
            packed = rows.field(1).to_numpy()[order].astype(np.uint32), (bits[0] | bits[1] << 1 | bits[2] << 2)[order]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), *(pa.array([x.tobytes()], pa.binary()) for x in packed)], ["block", "h", "kinds"])


def permutation_p(gaps: DataFrame) -> DataFrame:
    """One row (observed gap, replicates, two-sided p-value) from `permutation_gap`.

    The p-value counts the observed pairing among the replicates, so it is never zero.
    """
    seen = gaps.filter("rep = 0").select("gap").scalar()
    extreme = F.round(F.abs(F.col("gap")), 9) >= F.round(F.abs(seen), 9)
    return gaps.filter("rep > 0").agg(
        F.max(seen).alias("gap"), F.count(F.lit(1)).alias("reps"),
        ((F.sum(extreme.cast("long")) + 1) / (F.count(F.lit(1)) + 1)).alias("p_value"),
    )
