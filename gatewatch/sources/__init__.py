from gatewatch.sources.tables import load_table, login_events
