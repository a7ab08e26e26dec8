"""The vocabularies as the SQL checks know them: written by hand, not taken from the code they check."""

ANOMALY_SQL = r"""(VALUES
    ('bearing wear', '\bbearing\w*\W+(wear|worn|damag|pit|spall)\w*', 0.95::DOUBLE), ('seizure', '\bseiz\w*', 1.0::DOUBLE), ('vibration', '\bvibrat\w*', 0.8::DOUBLE),
    ('overheating', '\boverheat\w*|\bexcess\w*\W+temperatur\w*', 0.85::DOUBLE), ('leak', '\bleak\w*', 0.75::DOUBLE), ('misalignment', '\bmisalign\w*', 0.8::DOUBLE), ('cavitation', '\bcavitat\w*', 0.85::DOUBLE),
    ('abnormal noise', '\b(abnormal|unusual|excess)\w*\W+(nois|sound|rattl)\w*', 0.7::DOUBLE), ('crack', '\bcrack\w*', 0.9::DOUBLE), ('corrosion', '\bcorro\w*', 0.7::DOUBLE),
    ('erratic reading', '\b(erratic|fluctuat|unstab)\w*\W+(reading|value|signal|trend)\w*', 0.65::DOUBLE), ('trip', '\btrip\w*\W+(on|due)\w*', 0.8::DOUBLE)) v(term, pattern, weight)"""
BYPASS_SQL = r"""(VALUES
    ('bypass', '\bbypass\w*|\bby\w*\W+pass\w*', 1.0::DOUBLE), ('override', '\boverrid\w*', 0.92::DOUBLE), ('inhibit', '\binhibit\w*', 0.92::DOUBLE), ('silenced', '\bsilenc\w*', 0.8::DOUBLE),
    ('acknowledged and cleared', '\backnowledg\w*\W+(and|then)\w*\W+clear\w*', 0.95::DOUBLE)) v(term, pattern, weight)"""
DIAGNOSTIC_SQL = r"""(VALUES
    ('defect', '\b(wear|leak|crack|corro|damag)\w*|\bhigh\w*\W+vibrat\w*', 1.0::DOUBLE), ('stop', '\b(trip|stop|shut)\w*\W+(on|due|by|after)\w*|\btaken\w*\W+out\w*\W+of\w*\W+service\w*', 1.0::DOUBLE),
    ('bypass', '\b(bypass|overrid|inhibit)\w*\W+(was|is|in|left|kept)\w*', 1.0::DOUBLE)) v(term, pattern, weight)"""
KINDS_SQL = """CASE WHEN contains(t, 'incident') OR contains(t, 'near miss') THEN 'incident_report'
    WHEN contains(t, 'work order') OR contains(t, 'material:') OR contains(t, 'spares used') THEN 'work_order'
    WHEN contains(t, 'shift') OR contains(t, 'handed over') THEN 'shift_log'
    WHEN contains(t, 'inspection') OR contains(t, 'thickness readings') OR contains(t, 'calibration') THEN 'inspection_report'
    WHEN contains(t, 'procedure') OR contains(t, 'wear face protection') OR contains(t, 'check that the suction valve') THEN 'sop'
    WHEN contains(t, 'shall be') OR contains(t, 'regulation') THEN 'regulation' ELSE 'unknown' END"""
#: Readings in the usual unit of their parameter; r is the reading.
USUAL_SQL = """CASE WHEN parameter = 'discharge_pressure_bar' AND lower(trim(unit)) = 'psi' THEN value * 0.0689475729::DOUBLE
    WHEN parameter = 'discharge_pressure_bar' AND lower(trim(unit)) = 'kpa' THEN value * 0.01::DOUBLE WHEN parameter = 'discharge_pressure_bar' AND lower(trim(unit)) = 'mpa' THEN value * 10.0::DOUBLE
    WHEN parameter = 'temperature_c' AND lower(trim(unit)) = 'degf' THEN value * (5.0::DOUBLE / 9.0::DOUBLE) + (-160.0::DOUBLE / 9.0::DOUBLE) WHEN parameter = 'temperature_c' AND lower(trim(unit)) = 'k' THEN value - 273.15::DOUBLE
    WHEN parameter = 'flow_m3_h' AND lower(trim(unit)) = 'l/min' THEN value * 0.06::DOUBLE WHEN parameter = 'flow_m3_h' AND lower(trim(unit)) = 'gpm' THEN value * 0.2271247::DOUBLE
    WHEN parameter = 'flow_m3_h' AND lower(trim(unit)) = 'l/s' THEN value * 3.6::DOUBLE WHEN parameter = 'vibration_mm_s' AND lower(trim(unit)) = 'in/s' THEN value * 25.4::DOUBLE ELSE value END"""
