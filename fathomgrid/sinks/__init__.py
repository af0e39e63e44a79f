"""Writers: mosaics, reports, telemetry envelopes, topic tables."""
