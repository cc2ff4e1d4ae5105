"""Normalisation vectors."""

from pyspark.sql import functions as F

from turnout.functions import keys as K


def one(spark, expr, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(expr(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first()["x"]


def email(spark, text):
    def parts(c):
        t = K.email_text(c)
        local, dom = K.email_local(t), K.email_domain(t)
        return F.struct(F.when(t.contains("@"), F.concat_ws("@", local, dom)).otherwise(t).alias("email"), local.alias("local"), dom.alias("dom"))

    return tuple(one(spark, parts, text))


def test_email_is_trimmed_lowered_and_split_at_the_last_at(spark):
    assert email(spark, "\tNora.VELA@Correo.ORG") == ("nora.vela@correo.org", "nora.vela", "correo.org")
    assert email(spark, "uno@dos@tres.org") == ("uno@dos@tres.org", "uno@dos", "tres.org")
    assert email(spark, "sin arroba")[2] == "" and email(spark, "")[0] == email(spark, None)[0] == ""


def test_alias_is_cut_at_the_first_plus(spark):
    assert email(spark, "nora+lista+extra@correo.org")[1] == "nora"
    assert email(spark, "nora@correo.org")[1] == "nora"


def test_domain_repair_is_idempotent_and_leaves_strangers(spark):
    for right, typos in {"gmail.com": ("gmal.com", "gmai.com"), "hotmail.com": ("hotmai.com",)}.items():
        for typo in typos:
            assert one(spark, K.fix_domain, typo) in (right, typo)
            assert one(spark, K.fix_domain, one(spark, K.fix_domain, typo)) == one(spark, K.fix_domain, typo)
        assert one(spark, K.fix_domain, right) == right
    assert one(spark, K.fix_domain, "museo-del-agua.org") == "museo-del-agua.org"
    for typo in K.DOMAIN_TYPOS:
        assert one(spark, K.fix_domain, typo) == K.DOMAIN_TYPOS[typo]


def test_core_drops_marks_and_digits(spark):
    cores = {one(spark, K.local_core, v) for v in ("nora.vela", "nora_vela9", "noravela2001", "nora-vela")}
    assert len(cores) == 1 and cores.pop().isalpha()


def test_phone_keeps_ten_digits(spark):
    written = ("318 777 0042", "+57 (318) 777-0042", "57.318.777.0042", "3187770042")
    assert {one(spark, K.norm_phone, v) for v in written} == {"3187770042"}
    assert one(spark, K.norm_phone, "5790001112") == "5790001112"  # ten digits that begin with 57 are a number of their own
    for short in ("42", "   ", None):
        assert one(spark, K.norm_phone, short) == ""


def test_swaps_differ_in_two_neighbours(spark):
    number = "3187770042"
    got = one(spark, K.adjacent_swaps, number)
    assert number not in got and len(got) == len(set(got)) == sum(a != b for a, b in zip(number, number[1:]))
    for other in got:
        off = [i for i in range(10) if other[i] != number[i]]
        assert off == [off[0], off[0] + 1] and sorted(other) == sorted(number)
    assert one(spark, K.adjacent_swaps, "") == []


def test_deletions_leave_out_one_letter(spark):
    assert set(one(spark, K.deletions, "vela")) == {"ela", "vla", "vea", "vel"}
    assert set(one(spark, K.deletions, "ooo")) == {"oo"}
    assert one(spark, K.deletions, "") == []


def sim(spark, sale, user):
    return one(spark, lambda a, b: K.name_similarity(K.name_set(a), K.name_set(b)), sale, user)


def test_name_key_forgets_order_case_accents_and_particles(spark):
    keys = {one(spark, K.name_key, v) for v in ("Inés Peña", "peña INÉS", "pena  ines")}
    assert keys == {"ines pena"}
    assert one(spark, K.name_key, "Inés de los Ríos") == one(spark, K.name_key, "Ríos Inés")


def test_name_similarity_grows_with_agreement(spark):
    user = "Inés Peña"
    levels = [sim(spark, sale, user) for sale in ("", "Otto Braun", "I Peña", "Ines Penna", "Ines Pena")]
    assert levels[0] == 0.0 and levels == sorted(levels) and levels[-1] == 1.0 and levels[1] < levels[2] < levels[3]


def test_name_block_keys_cover_similarity(spark):
    """Any positive similarity implies a shared block key."""
    names = ["Ines Pena", "I Pena", "Inez Penna", "Pena Ines Vela", "V Braun", "Brau Ines", "Braun", "Rios Otto", "O Riox", "Nora Vela"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    a = df.select(F.col("n").alias("a"), K.name_set(F.col("n")).alias("sa"))
    b = df.select(F.col("n").alias("b"), K.name_set(F.col("n")).alias("sb"))
    subs = lambda c: F.transform(c, lambda x: x["sub"])
    bad = a.join(b, F.lit(True)).filter(
        (K.name_similarity(F.col("sa"), F.col("sb")) > 0)
        & ~F.arrays_overlap(subs(K.name_block_keys(F.col("sa"), "sale")), subs(K.name_block_keys(F.col("sb"), "user")))
    )
    assert bad.collect() == []
