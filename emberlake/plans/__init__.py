"""The registered queries of the engine, each beside the SQL that must give the same rows."""
