"""The five input tables derived from a star schema (lineitem, orders, customer,
supplier, events), as SQL that both Spark and an ANSI engine can run.

show = supplier, ticket = lineitem, sale = orders, user = customer, history = events.
Every derived value is integer arithmetic on keys, so both engines agree exactly.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

from turnout.sources.tables import Tables

AS_OF = "2024-01-25 00:00:00"
PRIME = 2147483647

# The four ticket types and the four channels.
COURTESY, GENERAL, PREFERRED, VIP = "Cortesía", "General", "Preferencial", "VIP"

_FIRST = "Ana,Luis,María,José,Camila,Andrés,Sofía,Juan,Valentina,Carlos,Lucía,Diego,Paula,Felipe,Laura,Mateo"
_FIRST_ASCII = "ana,luis,maria,jose,camila,andres,sofia,juan,valentina,carlos,lucia,diego,paula,felipe,laura,mateo"
_LAST = "Ruiz,Gómez,López,Rodríguez,Pérez,García,Díaz,Torres,Muñoz,Castro,Rojas,Vargas,Moreno,Ortiz,Silva,Cruz"
_LAST_ASCII = "ruiz,gomez,lopez,rodriguez,perez,garcia,diaz,torres,munoz,castro,rojas,vargas,moreno,ortiz,silva,cruz"
_DOMAINS = "gmail.com,hotmail.com,outlook.com,yahoo.com,icloud.com,proton.me"
_BROKEN = "gmial.com,hotmial.com,outlok.com,yahooo.com,iclod.com,protonme"


def _pick(words: str, index: str) -> str:
    return f"split_part('{words}', ',', cast({index} as int) + 1)"


def _person(source: str, key: str, keep: str) -> str:
    """Identity of person `key`: names, mailbox, domain and phone."""
    n_last = f"cast(floor({key} / 16) as bigint) % 16"
    n_dom = f"cast(floor({key} / 256) as bigint) % 6"
    return f"""
      select {keep},
             {_pick(_FIRST, f'{key} % 16')} as first_name,
             {_pick(_LAST, n_last)} as last_name,
             {_pick(_FIRST_ASCII, f'{key} % 16')} || '.' || {_pick(_LAST_ASCII, n_last)}
               || case when {key} % 4 = 0 then '' else cast({key} % 1000 as string) end as mailbox,
             {_pick(_DOMAINS, n_dom)} as domain,
             {_pick(_BROKEN, n_dom)} as broken_domain,
             '3' || lpad(cast(({key} % {PRIME} * 7919 + 12345) % 1000000000 as string), 9, '0') as digits
      from {source}"""


def _start(key: str) -> str:
    return f"(timestamp '2024-01-01 20:00:00' + interval '1' day * cast(({key} * 13) % 35 as int))"


def _ticket_hash(mult: int) -> str:
    return (
        f"((l_orderkey % {PRIME} * 48271 + l_partkey % {PRIME} * 69621 + l_suppkey % {PRIME} * 40692"
        f" + l_linenumber * 39373 + cast(l_quantity as bigint) * 16807) % {PRIME} * {mult} + 713) % {PRIME}"
    )


def sql_texts(lineitem="lineitem", orders="orders", customer="customer", supplier="supplier",
              events="events") -> dict[str, str]:
    shows = f"""
      select s_suppkey as event_id, s_suppkey % 14 as artist_id,
             'Act ' || cast(s_suppkey % 14 as string) as artist_name, s_name as title,
             case when {_start('s_suppkey')} < timestamp '2024-02-01 00:00:00'
                  then '2024-01' else '2024-02' end as month,
             {_start('s_suppkey')} as starts_at,
             cast(case when s_suppkey % 50 = 7 then 0 else 250 + 50 * (s_suppkey % 12) end as int) as capacity,
             'Venue ' || cast(s_nationkey as string) as venue, s_nationkey as city,
             cast((s_suppkey * 13) % 35 % 7 as string) as weekday,
             s_suppkey % 3 = 0 as is_residency, s_suppkey % 5 <> 0 as is_paid
      from {supplier}"""
    tickets = f"""
      select ticket_id, sale_id, event_id, ticket_type, price, checked_in,
             case when checked_in and arrival_hash % 20 <> 0
                  then starts_at + interval '1' second * cast(arrival_hash % 5400 - 3600 as int)
             end as checked_in_at
      from (
        select ticket_id, sale_id, event_id, ticket_type,
               case when ticket_type = '{COURTESY}' then null else face_price end as price,
               starts_at, arrival_hash,
               case when starts_at > timestamp '{AS_OF}' then null
                    when ticket_type = '{COURTESY}'
                      then label_hash < (39 + 2 * (event_id % 14 % 5)) * 21474836
                    else label_hash < (94 - event_id % 14 % 3) * 21474836 end as checked_in
        from (
          select cast(l_orderkey as string) || '-' || cast(l_partkey as string) || '-'
                   || cast(l_suppkey as string) || '-' || cast(l_linenumber as string) || '-'
                   || cast(cast(l_quantity as int) as string) as ticket_id,
                 l_orderkey as sale_id, l_suppkey as event_id,
                 case when l_returnflag = 'R' then '{COURTESY}'
                      when l_returnflag = 'A' then '{VIP}'
                      when l_linestatus = 'O' then '{GENERAL}' else '{PREFERRED}' end as ticket_type,
                 l_extendedprice as face_price,
                 {_start('l_suppkey')} as starts_at,
                 {_ticket_hash(1583458089)} as label_hash,
                 {_ticket_hash(784588716)} as arrival_hash
          from {lineitem}) k) l"""
    sale_source = f"""(select o_orderkey, o_orderpriority, o_custkey,
                 case when o_orderkey % 11 = 0 then o_custkey + 100000000 else o_custkey end as who
          from {orders}) o"""
    sales = f"""
      select o_orderkey as sale_id,
             case o_orderkey % 16
                  when 0 then '  ' || upper(mailbox || '@' || domain) || ' '
                  when 1 then mailbox || '+promo@' || domain
                  when 2 then mailbox || '@' || broken_domain
                  when 3 then substr(mailbox, 1, 1) || substr(mailbox, 3) || '@' || domain
                  when 4 then null
                  when 5 then 'partner' || cast(who % 700 as string) || '@gmail.com'
                  when 6 then mailbox || '@empresa-rara.co'
                  when 7 then mailbox
                  else mailbox || '@' || domain end as buyer_email,
             case when o_orderkey % 23 = 0 then '300 000 0000' else
             case o_orderkey % 7
                  when 0 then ''
                  when 1 then substr(digits, 1, 4) || substr(digits, 6, 1) || substr(digits, 5, 1) || substr(digits, 7)
                  when 2 then '+57 ' || substr(digits, 1, 3) || ' ' || substr(digits, 4)
                  when 3 then '(+57) ' || substr(digits, 1, 3) || '-' || substr(digits, 4, 3) || '-' || substr(digits, 7)
                  when 4 then '57' || digits
                  when 5 then null
                  else digits end end as buyer_phone,
             case o_orderkey % 9
                  when 0 then upper(first_name || ' ' || last_name)
                  when 1 then last_name || ' ' || first_name
                  when 2 then substr(first_name, 1, 1) || '. ' || last_name
                  when 3 then first_name || ' de la ' || last_name || ' Quintana'
                  when 4 then 'Beatriz Zambrano'
                  when 5 then lower(first_name) || ' ' || substr(last_name, 1, length(last_name) - 1)
                  else first_name || ' ' || last_name end as buyer_name,
             case when o_orderpriority like '1%' then 'WEB' when o_orderpriority like '2%' then 'BOX_OFFICE'
                  when o_orderpriority like '3%' then 'ADMIN' when o_orderpriority like '4%' then 'RRPP'
                  else 'WEB' end as channel,
             cast(1 + o_orderkey % 4 as int) as qty,
             case when o_orderkey % 17 = 0 then null
                  else timestamp '2023-12-28 09:30:00' + interval '1' minute * cast(o_orderkey % {PRIME} * 7121 % 51840 as int)
             end as purchased_at
      from ({_person(sale_source, 'who', 'o_orderkey, o_orderpriority, who')}) p"""
    users = f"""
      select c_custkey as user_id, mailbox || '@' || domain as email,
             case when c_custkey % 29 = 0 then '3000000000' else digits end as phone,
             first_name, last_name, c_nationkey as city, c_custkey % 3 = 0 as has_membership
      from ({_person(customer, 'c_custkey', 'c_custkey, c_nationkey')}) p"""
    history = f"""
      select user_id, case when event_type in ('purchase', 'click', 'view') then 'consumo_minimo'
                           when event_type = 'signup' then 'membresia' else 'otro' end as type,
             ts as created_at, value < 60 as used,
             case when value < 60 then ts + interval '1' hour * cast(event_id % 96 as int) end as date_used
      from {events}"""
    return {"shows": shows, "tickets": tickets, "sales": sales, "users": users, "history": history}


BASE_TABLES = ("lineitem", "orders", "customer", "supplier", "events")


def star_tables(spark: SparkSession, folder: str) -> Tables:
    """Tables over the Parquet files of `folder`; nothing is read before an action."""
    base = {n: spark.read.parquet(os.path.join(folder, f"{n}.parquet")) for n in BASE_TABLES}
    texts = sql_texts(**{n: "{" + n + "}" for n in BASE_TABLES})

    def run(name: str):
        text = texts[name]
        used = {n: df for n, df in base.items() if "{" + n + "}" in text}
        return spark.sql(text, **used)

    return Tables(users=run("users"), history=run("history"), events=run("shows"),
                  sales=run("sales"), tickets=run("tickets"))
