"""logferry: sanitise, judge, convert and audit coding-agent chat logs with Spark."""
