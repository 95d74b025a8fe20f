"""Sources and sinks: driver tables, adapters, intake, config, stores."""
