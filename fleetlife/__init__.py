"""fleetlife: survival analytics of device fleets as composable Spark DataFrame operators."""
