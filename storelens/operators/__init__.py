"""DataFrame-in / DataFrame-out operators of the retail analytics domain."""
