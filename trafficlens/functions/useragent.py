"""User-agent fields from an own rule table (no claim of value
parity with third-party parsers, whose rules are outside the reference).

The table is data: each field is an ordered CASE over regex conditions, with
a literal, a regex capture or a concatenation of earlier fields as value.
``spark_fields`` turns it into built-in column expressions (codegen, no UDF);
``sql_fields`` renders the same table for the DuckDB twin.  The job parses
each distinct agent once and joins the fields back (J1).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Agent rule patterns.
BOT = r"(?i)(bot|crawler|spider|slurp)"
SCRIPT = r"(?i)(curl|wget|python-requests|httpclient|okhttp)"
IOS = r"(iPhone|iPad|iPod)"
TABLET = r"(iPad|Tablet|SM-X|SM-T)"
MOBILE = r"(Mobile|iPhone|iPod)"
VER = r"([0-9]+(?:[._][0-9]+)*)"

# Each rule: (conditions, value); condition = (pattern, must_match);
# value = ("lit", text) | ("ext", pattern, group) | ("cat", [parts]) where a part
# is ("f", field) or ("lit", text); None default = null.
RULES: dict[str, tuple[list, tuple | None]] = {}


def _r(name, rules, default=("lit", "Unknown")):
    RULES[name] = (rules, default)


_r("isBot", [([(BOT, True)], ("lit", "true")), ([(SCRIPT, True)], ("lit", "true"))], ("lit", "false"))
_r("isTablet", [([(TABLET, True)], ("lit", "true")), ([("Android", True), ("Mobile", False)], ("lit", "true"))],
   ("lit", "false"))
_r("isMobile", [([(MOBILE, True), ("iPad", False)], ("lit", "true"))], ("lit", "false"))
_r("isTouch", [([(r"(iPhone|iPad|iPod|Android)", True)], ("lit", "true"))], ("lit", "false"))
_r("isPC", [([(r"(Windows NT|Macintosh|X11)", True)], ("lit", "true"))], ("lit", "false"))
_r("osFamily", [([(IOS, True)], ("lit", "iOS")), ([("Android", True)], ("lit", "Android")),
                ([("Windows NT", True)], ("lit", "Windows")), ([("Mac OS X", True)], ("lit", "Mac OS X")),
                ([("Linux", True)], ("lit", "Linux"))], ("lit", "Other"))
_r("osVersion", [([(IOS, True)], ("ext", r"OS ([0-9]+(?:_[0-9]+)*)", 1)),
                 ([("Android", True)], ("ext", r"Android " + VER, 1)),
                 ([("Windows NT", True)], ("ext", r"Windows NT " + VER, 1)),
                 ([("Mac OS X", True)], ("ext", r"Mac OS X " + VER, 1))], None)
_r("browserFamily", [([("Edg/", True)], ("lit", "Edge")),
                     ([("Chrome/", True), ("Mobile", True)], ("lit", "Chrome Mobile")),
                     ([("Chrome/", True)], ("lit", "Chrome")), ([("Firefox/", True)], ("lit", "Firefox")),
                     ([("Version/", True), ("Mobile", True)], ("lit", "Mobile Safari")),
                     ([("Version/", True), ("Safari", True)], ("lit", "Safari")),
                     ([("Googlebot", True)], ("lit", "Googlebot")), ([("(?i)bingbot", True)], ("lit", "bingbot")),
                     ([("curl/", True)], ("lit", "curl")), ([("python-requests", True)], ("lit", "Python Requests"))],
   ("lit", "Other"))
_r("browserVersion", [([("Edg/", True)], ("ext", "Edg/" + VER, 1)), ([("Chrome/", True)], ("ext", "Chrome/" + VER, 1)),
                      ([("Firefox/", True)], ("ext", "Firefox/" + VER, 1)),
                      ([("Version/", True)], ("ext", "Version/" + VER, 1)),
                      ([("Googlebot", True)], ("ext", "Googlebot/" + VER, 1)),
                      ([("(?i)bingbot", True)], ("ext", "(?i)bingbot/" + VER, 1)),
                      ([("curl/", True)], ("ext", "curl/" + VER, 1)),
                      ([("python-requests", True)], ("ext", "python-requests/" + VER, 1))], None)
_r("deviceBrand", [([(r"(iPhone|iPad|iPod|Macintosh)", True)], ("lit", "Apple")), ([("Pixel", True)], ("lit", "Google")),
                   ([("SM-", True)], ("lit", "Samsung"))], ("lit", "Unknown"))
_r("deviceModel", [([("iPhone", True)], ("lit", "iPhone")), ([("iPad", True)], ("lit", "iPad")),
                   ([("Macintosh", True)], ("lit", "Mac")),
                   ([("Android", True)], ("ext", r"Android [0-9.]+; ([^;)]+)", 1))], ("lit", "Unknown"))
_r("deviceFamily", [([(BOT, True)], ("lit", "Spider")), ([(SCRIPT, True)], ("lit", "Other")),
                    ([(r"(iPhone|iPad|Android)", True)], ("cat", [("f", "deviceBrand"), ("lit", " "), ("f", "deviceModel")]))],
   ("lit", "Other"))
_r("DeviceClass", [([(BOT, True)], ("lit", "Robot")), ([(SCRIPT, True)], ("lit", "Robot")),
                   ([(TABLET, True)], ("lit", "Tablet")), ([("Android", True), ("Mobile", False)], ("lit", "Tablet")),
                   ([(MOBILE, True)], ("lit", "Phone")), ([(r"(Windows NT|Macintosh|X11)", True)], ("lit", "Desktop"))])
_r("DeviceCpu", [([(r"(x86_64|Win64|x64)", True)], ("lit", "Intel x86_64")), ([("Intel Mac", True)], ("lit", "Intel"))])
_r("DeviceCpuBits", [([(r"(x86_64|Win64|x64)", True)], ("lit", "64"))])
_r("OperatingSystemClass", [([(BOT, True)], ("lit", "Cloud")), ([(r"(iPhone|iPad|Android)", True)], ("lit", "Mobile")),
                            ([(r"(Windows NT|Macintosh|X11)", True)], ("lit", "Desktop"))])
_r("LayoutEngineName", [([("(Chrome/|Edg/)", True)], ("lit", "Blink")), ([("AppleWebKit/", True)], ("lit", "AppleWebKit")),
                        ([("Gecko/", True), ("rv:", True)], ("lit", "Gecko"))])
_r("LayoutEngineVersion", [([("(Chrome/|Edg/)", True)], ("ext", "Chrome/" + VER, 1)),
                           ([("AppleWebKit/", True)], ("ext", "AppleWebKit/" + VER, 1)),
                           ([("Gecko/", True), ("rv:", True)], ("ext", "rv:" + VER, 1))])
_r("AgentClass", [([(BOT, True)], ("lit", "Robot")), ([(SCRIPT, True)], ("lit", "Special")),
                  ([("Mozilla/", True)], ("lit", "Browser"))])

# Output names of the two schemas.
FIELDS_22 = ["DeviceClass", "DeviceName", "DeviceBrand", "DeviceCpu", "DeviceCpuBits", "OperatingSystemClass",
             "OperatingSystemName", "OperatingSystemVersion", "OperatingSystemNameVersion",
             "OperatingSystemVersionBuild", "LayoutEngineClass", "LayoutEngineName", "LayoutEngineVersion",
             "LayoutEngineVersionMajor", "LayoutEngineNameVersion", "LayoutEngineNameVersionMajor", "AgentClass",
             "AgentName", "AgentVersion", "AgentVersionMajor", "AgentNameVersion", "AgentNameVersionMajor"]
FIELDS_16 = ["userAgentIsBot", "userAgentIsMobile", "userAgentIsTablet", "userAgentIsTouchCapable", "userAgentIsPC",
             "userAgentOSFamily", "userAgentOSVersion0", "userAgentOSVersion1", "userAgentOSVersion2",
             "userAgentBrowserFamily", "userAgentBrowserVersion0", "userAgentBrowserVersion1",
             "userAgentBrowserVersion2", "userAgentDeviceFamily", "userAgentDeviceBrand", "userAgentDeviceModel"]


# ---- Spark form ---------------------------------------------------------------------------------

def _spark_value(v, ua: Column, done: dict) -> Column:
    if v is None:
        return F.lit(None).cast("string")
    if v[0] == "lit":
        return F.lit(v[1])
    if v[0] == "ext":
        return F.nullif(F.regexp_extract(ua, v[1], v[2]), F.lit(""))
    return F.concat(*[done[p[1]] if p[0] == "f" else F.lit(p[1]) for p in v[1]])


def _spark_rule_fields(ua: Column) -> dict[str, Column]:
    done: dict[str, Column] = {}
    for name, (rules, default) in RULES.items():
        expr = None
        for conds, val in rules:
            cond = None
            for pat, must in conds:
                c = ua.rlike(pat)
                c = c if must else ~c
                cond = c if cond is None else cond & c
            expr = F.when(cond, _spark_value(val, ua, done)) if expr is None else \
                expr.when(cond, _spark_value(val, ua, done))
        dv = _spark_value(default, ua, done)
        done[name] = expr.otherwise(dv) if expr is not None else dv
    return done


def _vpart(v: Column, i: int, default: str) -> Column:
    return F.coalesce(F.get(F.split(v, "[._]", -1), i), F.lit(default))


def spark_fields(ua_col: str = "userAgent", schema: int = 22) -> list[Column]:
    ua = F.col(ua_col)
    f = _spark_rule_fields(ua)
    unk = F.lit("Unknown")
    if schema == 16:
        b = lambda n: f[n] == "true"
        return [b("isBot").alias("userAgentIsBot"), b("isMobile").alias("userAgentIsMobile"),
                b("isTablet").alias("userAgentIsTablet"), b("isTouch").alias("userAgentIsTouchCapable"),
                b("isPC").alias("userAgentIsPC"), f["osFamily"].alias("userAgentOSFamily"),
                *[_vpart(f["osVersion"], i, "0").alias(f"userAgentOSVersion{i}") for i in range(3)],
                f["browserFamily"].alias("userAgentBrowserFamily"),
                *[_vpart(f["browserVersion"], i, "0").alias(f"userAgentBrowserVersion{i}") for i in range(3)],
                f["deviceFamily"].alias("userAgentDeviceFamily"), f["deviceBrand"].alias("userAgentDeviceBrand"),
                f["deviceModel"].alias("userAgentDeviceModel")]
    osv = F.coalesce(F.regexp_replace(f["osVersion"], "_", "."), unk)
    lev = F.coalesce(f["LayoutEngineVersion"], unk)
    lmaj = F.coalesce(F.get(F.split(f["LayoutEngineVersion"], "[.]", -1), 0), unk)
    av = F.coalesce(f["browserVersion"], unk)
    amaj = F.coalesce(F.get(F.split(f["browserVersion"], "[.]", -1), 0), unk)
    return [f["DeviceClass"].alias("DeviceClass"),
            F.concat_ws(" ", f["deviceBrand"], f["deviceModel"]).alias("DeviceName"),
            f["deviceBrand"].alias("DeviceBrand"), f["DeviceCpu"].alias("DeviceCpu"),
            f["DeviceCpuBits"].alias("DeviceCpuBits"), f["OperatingSystemClass"].alias("OperatingSystemClass"),
            f["osFamily"].alias("OperatingSystemName"), osv.alias("OperatingSystemVersion"),
            F.concat_ws(" ", f["osFamily"], osv).alias("OperatingSystemNameVersion"),
            unk.alias("OperatingSystemVersionBuild"),
            F.when(f["LayoutEngineName"] == "Unknown", unk).otherwise(F.lit("Browser")).alias("LayoutEngineClass"),
            f["LayoutEngineName"].alias("LayoutEngineName"), lev.alias("LayoutEngineVersion"),
            lmaj.alias("LayoutEngineVersionMajor"),
            F.concat_ws(" ", f["LayoutEngineName"], lev).alias("LayoutEngineNameVersion"),
            F.concat_ws(" ", f["LayoutEngineName"], lmaj).alias("LayoutEngineNameVersionMajor"),
            f["AgentClass"].alias("AgentClass"), f["browserFamily"].alias("AgentName"), av.alias("AgentVersion"),
            amaj.alias("AgentVersionMajor"), F.concat_ws(" ", f["browserFamily"], av).alias("AgentNameVersion"),
            F.concat_ws(" ", f["browserFamily"], amaj).alias("AgentNameVersionMajor")]


def parse_agents(df: DataFrame, ua_col: str = "userAgent", schema: int = 22) -> DataFrame:
    """Parse each distinct non-null agent once (the distinct set is far smaller than the rows)."""
    return df.where(F.col(ua_col).isNotNull()).select(ua_col).distinct() \
        .select(ua_col, *spark_fields(ua_col, schema))


def enrich(df: DataFrame, ua_col: str = "userAgent", schema: int = 22) -> DataFrame:
    """P21/P22 + J1: fields joined back on the agent text; rows with a null agent drop out."""
    return df.join(parse_agents(df, ua_col, schema), ua_col, "inner")


# ---- DuckDB twin ------------------------------------------------------------------------------

def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_value(v, ua: str, done: dict) -> str:
    if v is None:
        return "CAST(NULL AS VARCHAR)"
    if v[0] == "lit":
        return _q(v[1])
    if v[0] == "ext":
        return f"nullif(regexp_extract({ua}, {_q(v[1])}, {v[2]}), '')"
    return "(" + " || ".join(f"({done[p[1]]})" if p[0] == "f" else _q(p[1]) for p in v[1]) + ")"


def _sql_rule_fields(ua: str) -> dict[str, str]:
    done: dict[str, str] = {}
    for name, (rules, default) in RULES.items():
        whens = []
        for conds, val in rules:
            cond = " AND ".join(("" if must else "NOT ") + f"regexp_matches({ua}, {_q(pat)})" for pat, must in conds)
            whens.append(f"WHEN {cond} THEN {_sql_value(val, ua, done)}")
        dv = _sql_value(default, ua, done)
        done[name] = f"(CASE {' '.join(whens)} ELSE {dv} END)" if whens else dv
    return done


def _sql_vpart(v: str, i: int, default: str) -> str:
    return f"coalesce(string_split_regex({v}, '[._]')[{i + 1}], {_q(default)})"


def sql_fields(ua: str = "userAgent", schema: int = 22) -> list[str]:
    f = _sql_rule_fields(ua)
    if schema == 16:
        b = lambda n: f"({f[n]} = 'true')"
        return [f"{b('isBot')} AS userAgentIsBot", f"{b('isMobile')} AS userAgentIsMobile",
                f"{b('isTablet')} AS userAgentIsTablet", f"{b('isTouch')} AS userAgentIsTouchCapable",
                f"{b('isPC')} AS userAgentIsPC", f"{f['osFamily']} AS userAgentOSFamily",
                *[f"{_sql_vpart(f['osVersion'], i, '0')} AS userAgentOSVersion{i}" for i in range(3)],
                f"{f['browserFamily']} AS userAgentBrowserFamily",
                *[f"{_sql_vpart(f['browserVersion'], i, '0')} AS userAgentBrowserVersion{i}" for i in range(3)],
                f"{f['deviceFamily']} AS userAgentDeviceFamily", f"{f['deviceBrand']} AS userAgentDeviceBrand",
                f"{f['deviceModel']} AS userAgentDeviceModel"]
    osv = f"coalesce(replace({f['osVersion']}, '_', '.'), 'Unknown')"
    lev = f"coalesce({f['LayoutEngineVersion']}, 'Unknown')"
    lmaj = f"coalesce(string_split_regex({f['LayoutEngineVersion']}, '[.]')[1], 'Unknown')"
    av = f"coalesce({f['browserVersion']}, 'Unknown')"
    amaj = f"coalesce(string_split_regex({f['browserVersion']}, '[.]')[1], 'Unknown')"
    return [f"{f['DeviceClass']} AS DeviceClass", f"concat_ws(' ', {f['deviceBrand']}, {f['deviceModel']}) AS DeviceName",
            f"{f['deviceBrand']} AS DeviceBrand", f"{f['DeviceCpu']} AS DeviceCpu",
            f"{f['DeviceCpuBits']} AS DeviceCpuBits", f"{f['OperatingSystemClass']} AS OperatingSystemClass",
            f"{f['osFamily']} AS OperatingSystemName", f"{osv} AS OperatingSystemVersion",
            f"concat_ws(' ', {f['osFamily']}, {osv}) AS OperatingSystemNameVersion",
            "'Unknown' AS OperatingSystemVersionBuild",
            f"CASE WHEN {f['LayoutEngineName']} = 'Unknown' THEN 'Unknown' ELSE 'Browser' END AS LayoutEngineClass",
            f"{f['LayoutEngineName']} AS LayoutEngineName", f"{lev} AS LayoutEngineVersion",
            f"{lmaj} AS LayoutEngineVersionMajor",
            f"concat_ws(' ', {f['LayoutEngineName']}, {lev}) AS LayoutEngineNameVersion",
            f"concat_ws(' ', {f['LayoutEngineName']}, {lmaj}) AS LayoutEngineNameVersionMajor",
            f"{f['AgentClass']} AS AgentClass", f"{f['browserFamily']} AS AgentName", f"{av} AS AgentVersion",
            f"{amaj} AS AgentVersionMajor", f"concat_ws(' ', {f['browserFamily']}, {av}) AS AgentNameVersion",
            f"concat_ws(' ', {f['browserFamily']}, {amaj}) AS AgentNameVersionMajor"]
