"""DataFrame operators for screening sites on maps, and for evaluating the screening."""
