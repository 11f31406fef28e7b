"""keyloom: ordered key/value maps, sets, priority queues and vectors as DataFrame plans."""
