"""SQL building blocks that restate the registry pipeline for the comparison engine."""

SUFFIX = r"\b(incorporated|inc|llc|ltd|lp|llp|corp|corporation|company|co|plc|gmbh|sa|nv|bv|the|and)\b"
JUNK = "('na','n a','n/a','unknown','none','-','','test','tbd','xxx','not applicable')"
BUSINESS = (r"(?i)\b(incorporated|inc|llc|ltd|lp|llp|corp|corporation|co|company|group|holdings?|farms?"
            r"|foods?|storage|logistics|cold|warehouse|packing|meats?|dairy|dairies|market|markets"
            r"|produce|fresh|frozen|services?|supply|industries|packers|cooperative|coop|distribution"
            r"|transport|brands?|kitchen|provisions|cheese|beef|pork|poultry|seafood|grocer\w*|wholesale"
            r"|terminal|plant|division|center|centre|intl|international|usa|america\w*|bakers?|chef|pure)\b")


def key_of(x: str) -> str:
    return f"regexp_replace(regexp_replace(lower({x}), '{SUFFIX}', ' ', 'g'), '[^a-z0-9&]', '', 'g')"


def norm_of(x: str) -> str:
    return (f"trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce({x},'')), "
            f"'[^a-z0-9& ]', ' ', 'g'), '{SUFFIX}', ' ', 'g'), '\\s+', ' ', 'g'))")


def shown_of(x: str) -> str:
    return (f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, "
            f"'(?i){SUFFIX}', ' ', 'g'), '[-/_,]', ' ', 'g'), '[''’.]', '', 'g'), "
            f"'[^A-Za-z0-9& ]', ' ', 'g'), '\\s+', ' ', 'g'))")


def person_test(x: str) -> str:
    return (f"(regexp_matches(trim({x}), '^[A-Z][a-z]+(?: [A-Z]\\.?)? [A-Z][a-z]+$') "
            f"AND NOT regexp_matches(trim({x}), '{BUSINESS}'))")


LINES = """
lines AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey
                                 ORDER BY l_shipdate DESC, l_extendedprice DESC) AS rn
    FROM lineitem) WHERE rn = 1)"""

FILINGS = """
filings AS (
  SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS facility_id,
    ((l_orderkey * 10 + l_linenumber)::VARCHAR || lpad(l_partkey::VARCHAR, 12, '0')
      || lpad(l_suppkey::VARCHAR, 12, '0'))::HUGEINT AS ord,
    CASE WHEN l_orderkey % 200 = 7 THEN 'Depot ' || l_orderkey || '-' || l_linenumber || '-'
              || l_partkey || '-' || l_suppkey
         WHEN l_orderkey % 500 = 3 THEN 'N/A'
         WHEN l_linenumber = 1 THEN p_name || ', Inc.'
         WHEN l_linenumber = 2 THEN p_name || ' LLC'
         WHEN l_linenumber = 3 THEN upper(p_name)
         WHEN l_linenumber = 4 THEN replace(p_name, ' ', '-')
         WHEN l_linenumber = 5 THEN p_name || ' III' END AS parent_name,
    CASE WHEN l_linenumber = 6 THEN list_aggregate(list_transform(string_split(p_name, ' '),
              lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ')
         WHEN l_linenumber = 7 THEN p_name || ' Foods, Inc.' END AS operator_name,
    p_name || ' Works (' || n_name || ')' AS facility_name,
    s_name AS city, n_name AS state, r_name AS rto, p_brand AS naics,
    (l_quantity * 1000)::BIGINT * CASE WHEN l_orderkey % 5000 = 1 THEN 10000 ELSE 1 END AS charge_lb,
    CASE WHEN l_linenumber % 2 = 1 THEN (l_quantity * 2500)::BIGINT
              * CASE WHEN l_orderkey % 7000 = 2 THEN 1000 ELSE 1 END ELSE 0 END AS chlorine_lb,
    l_linenumber % 3 + 1 AS program_level,
    CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS accidents, (l_linenumber % 4)::INTEGER AS submissions,
    CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 1 ELSE 0 END AS recent_accidents,
    l_returnflag = 'A' AND l_linestatus = 'F' AS is_deregistered
  FROM lines JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

NAMED = f"""
named0 AS (
  SELECT *, (parent_name IS NULL OR trim(parent_name) = '')
            AND coalesce({person_test('operator_name')}, false) AS operator_is_person,
    trim(regexp_replace(facility_name, '\\s*\\([^)]*\\)\\s*$', '')) AS facility_bare
  FROM filings WHERE NOT is_deregistered),
named AS (
  SELECT *, CASE WHEN operator_is_person THEN coalesce(nullif(parent_name, ''), facility_bare, operator_name)
                 ELSE coalesce(nullif(parent_name, ''), operator_name, facility_bare) END AS reported
  FROM named0)"""

RULED = """CASE WHEN regexp_matches(lower(reported), '(^|[^a-z0-9])old widget') THEN 'Old Widget Holdings'
              WHEN regexp_matches(lower(reported), '(^|[^a-z0-9])red ring') THEN 'Red Ring Group'
              WHEN regexp_matches(lower(reported), '(^|[^a-z0-9])(blue gear|blue gizmo)') THEN 'Blue Gear Corp.' END"""
LOOSE = """CASE WHEN lower(reported) LIKE '%old widget%' THEN 'Old Widget Holdings'
              WHEN lower(reported) LIKE '%red ring%' THEN 'Red Ring Group'
              WHEN lower(reported) LIKE '%blue gear%' OR lower(reported) LIKE '%blue gizmo%' THEN 'Blue Gear Corp.' END"""


def spellings(ruled: str, loose: str = "NULL") -> str:
    return f"""
sp0 AS (
  SELECT reported, {ruled} AS ruled, {loose} AS loose FROM (SELECT DISTINCT reported FROM named WHERE reported IS NOT NULL)),
sp1 AS (
  SELECT *, {key_of('reported')} AS k0, {shown_of('reported')} AS s0, {norm_of('reported')} AS n0 FROM sp0),
sp2 AS (
  SELECT *, k0 <> '' AND s0 <> '' AND n0 <> '' AND k0 NOT IN {JUNK} AND n0 NOT IN {JUNK} AS ok FROM sp1),
spellings AS (
  SELECT reported, CASE WHEN ruled IS NOT NULL THEN {key_of('ruled')} WHEN ok THEN k0 END AS key,
    CASE WHEN ruled IS NOT NULL THEN ruled WHEN ok THEN s0 END AS shown,
    CASE WHEN ruled IS NOT NULL THEN 'rule' WHEN ok THEN 'fallback' END AS resolved_by,
    loose, {key_of('loose')} AS loose_key
  FROM sp2)"""


SITES = """
pop AS (
  SELECT charge_lb AS v, row_number() OVER (ORDER BY charge_lb) - 1 AS rn, count(*) OVER () AS n
  FROM named JOIN spellings USING (reported) WHERE key IS NOT NULL AND charge_lb > 0),
stats AS (
  SELECT coalesce(max(n), 0) AS n,
    coalesce(max(v) FILTER (rn = least(n - 1, floor(n * 0.99::DOUBLE)::BIGINT)), 0) AS p99,
    coalesce(max(v) FILTER (rn = least(n - 1, floor(n * 0.5::DOUBLE)::BIGINT)), 0) AS median
  FROM pop),
sites AS (
  SELECT named.*, charge_lb <= p99 * 10 AS validated,
    CASE WHEN charge_lb > p99 * 10 THEN
      'charge_lb ' || format('{:,}', charge_lb) || ' exceeds p99 (' || format('{:,}', p99)
      || ' lb) x 10; median is ' || format('{:,}', median) || ' lb. Probable units error or NAICS '
      || 'misclassification in the self-reported filing. Excluded from scoring pending human review.'
      ELSE '' END AS validation_note
  FROM named, stats)"""

BUCKETS = f"""
keyed0 AS (SELECT sites.*, key, shown, resolved_by, loose, loose_key
           FROM sites JOIN spellings USING (reported) WHERE key IS NOT NULL),
own AS (
  SELECT key, shown AS name, bucket_ord FROM (
    SELECT key, shown, min(ord) OVER (PARTITION BY key) AS bucket_ord,
      row_number() OVER (PARTITION BY key ORDER BY resolved_by <> 'rule', ord) AS rn FROM keyed0)
  WHERE rn = 1),
stems AS (
  SELECT key, {key_of("regexp_extract(trim(name), '^(.+?)\\s+[#\\-]?\\s*(?:[IVX]{2,4}|\\d{1,3})$', 1)")} AS stem_key
  FROM own),
merges AS (
  SELECT s.key, s.stem_key AS final_key FROM stems s
  WHERE s.stem_key <> '' AND s.stem_key <> s.key AND s.stem_key IN (SELECT key FROM own)),
keyed AS (
  SELECT keyed0.*, coalesce(final_key, key) AS account_key, final_key IS NOT NULL AS merged
  FROM keyed0 LEFT JOIN merges USING (key)),
totals AS (
  SELECT account_key, count(*) AS sites, count(*) FILTER (NOT validated) AS unvalidated_sites,
    count(*) FILTER (validated) AS ok_sites,
    coalesce(sum(charge_lb) FILTER (validated), 0)::BIGINT AS charge_lb,
    coalesce(max(charge_lb) FILTER (validated), 0) AS max_site_charge_lb,
    count(DISTINCT state) AS states,
    string_agg(DISTINCT state, ',' ORDER BY state) AS state_list,
    sum(accidents)::BIGINT AS accidents,
    count(*) FILTER (validated AND accidents > 0) AS sites_with_accidents
  FROM keyed GROUP BY account_key),
mode_rto AS (
  SELECT account_key, rto AS primary_rto FROM (
    SELECT account_key, rto, row_number() OVER (PARTITION BY account_key ORDER BY n DESC, at_merged, at_ord) AS rn
    FROM (SELECT account_key, rto, count(*) AS n, min(merged) AS at_merged,
            coalesce(min(ord) FILTER (NOT merged), min(ord)) AS at_ord FROM keyed GROUP BY ALL)) WHERE rn = 1),
mode_naics AS (
  SELECT account_key, naics AS primary_naics FROM (
    SELECT account_key, naics, row_number() OVER (PARTITION BY account_key ORDER BY n DESC, at_merged, at_ord) AS rn
    FROM (SELECT account_key, naics, count(*) AS n, min(merged) AS at_merged,
            coalesce(min(ord) FILTER (NOT merged), min(ord)) AS at_ord FROM keyed GROUP BY ALL)) WHERE rn = 1),
buckets AS (
  SELECT totals.*, own.name AS account, bucket_ord, primary_rto, primary_naics,
    own.name IN ('Old Widget Holdings', 'hot rod') AS is_customer,
    CASE WHEN regexp_matches(primary_naics, '^Brand#([1-9]|10)$')
         THEN 'Segment ' || substr(primary_naics, 7) ELSE 'Other' END AS vertical,
    ok_sites >= 2 OR max_site_charge_lb >= 40000 AS admitted
  FROM totals JOIN own ON account_key = key JOIN mode_rto USING (account_key)
    JOIN mode_naics USING (account_key)),
scored AS (
  SELECT *, least(20, sites * 2) AS scale,
    least(25, round_even(charge_lb / 40000, 0)::BIGINT) AS refrig_intensity,
    least(15, states * 2) AS geographic_spread,
    CASE WHEN primary_rto IN ('ASIA', 'EUROPE') THEN 14 WHEN primary_rto = 'AMERICA' THEN 10 ELSE 6 END AS grid_exposure,
    least(12, sites_with_accidents * 3) AS replacement_signal,
    CASE WHEN primary_naics = 'Brand#12' THEN 14 ELSE 9 END AS vertical_fit
  FROM buckets WHERE admitted),
accounts AS (
  SELECT *, least(100, scale + refrig_intensity + geographic_spread + grid_exposure
                       + replacement_signal + vertical_fit)::BIGINT AS icp_score,
    row_number() OVER (ORDER BY sites DESC, charge_lb DESC, bucket_ord) AS rank
  FROM scored)"""

BASE = "WITH " + ",".join([LINES, FILINGS, NAMED])
RESOLVED = ",".join([BASE, spellings(RULED, LOOSE)])
FLAGGED = ",".join([RESOLVED, SITES])
ROLLED = ",".join([FLAGGED, BUCKETS])
