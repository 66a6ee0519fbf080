"""Sources, sinks and adapter views."""
