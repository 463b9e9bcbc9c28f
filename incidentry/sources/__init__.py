"""Readers and writers: driver-table views, JSON log feeds, rules tables, the tagged-log and event/incident stores."""
