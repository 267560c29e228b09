"""Sources and sinks: typed JSON Lines, load specs, run files, label stores, manifests."""
