"""The built-in format profiles, in tie-break order.

Fixed values: file name globs, expressions, formats and severity words of 22 common log formats.
"""

PROFILES = [
    {
        "id": 'veeam-vbr', "name": 'Veeam Backup & Replication', "mode": 'continuation', "format": '%d.%m.%Y %H:%M:%S',
        "files": [
            'Svc.Veeam*.log', 'Svc.Veeam*_[0-9]*.log', 'Svc.*.log', 'Job.*.log', 'BackupCopy.*.log', 'Agent.*.log',
            'AgentUpdater*.log', 'EP.*.log', 'Endpoint.*.log', 'Task.*.log', 'Rpc.*.log', 'RPCAssemblyServer.log',
            'RTS.ResourcesUsage*.log', 'WmiServer.*.log', 'WmiServer.log', 'VeeamBackupManager.log', 'VeeamPowerShell.log', 'CatalogReplicationJob.log',
            'Veeam.WebApp.log', 'VeeamDeployer*.log', 'Mount.*.log', 'MountSvc.log', 'DataCollectionService*.log', 'Satellite*.log',
            'Dis*.log', 'DisServer*.log', 'DistributionSvc.log', 'Database*.log', 'DB.*.log', 'DbPlugin*.log',
            'DbPluginRedist.log', 'StorageMeta*.log', 'StorageSync*.log', 'Catalog*.log', 'RepoService*.log', 'Repo.*.log',
            'Broker*.log', 'Gateway*.log', 'CloudGateway*.log', 'CCdp*.log', 'CDP_Policy_*.log', 'CdpPolicy*.log',
            'CdpService*.log', 'ArchiveCleanup*.log', 'ArchiveSync*.log', 'SOBR_Offload*.log', 'Offload_*.log', 'ShadowBackupSync*.log',
            'AnalyticsService*.log', 'AutoProlongate.log', 'BackupDatabase*.log', 'BackupSrv*.log', 'BackupUpdateSvc.log', 'BackupVersionChecker*.log',
            'BackupWeb*.log', 'BackupSuite_*.log', 'BadRequestRegister.log', 'CleanupExpiredRetrievals.log', 'Copy_backup_*.log', 'Move_backup_*.log',
            'SetupBackup*.log', 'SuiteEngine_*.log', 'LogAnalyzer*.log', 'AvailabilityWatchdog*.log', 'BackgroundActivityWatchdog.log', 'CloudDatastore*.log',
            'CloudGateDispatcher.log', 'CloudProvider*.log', 'CloudThrottling*.log', 'DaemonDiskOwnershipWatchdog.log', 'HostEvents*.log', 'PolicySessions*.log',
            'ProxyChanges*.log', 'RestorePoint*.log', 'TargetDatastore*.log', 'TaskActivityWatchdog.log', 'AWSPlugin*.log', 'EntraIdPlugin*.log',
            'GCPPlugin*.log', 'KVMPlugin*.log', 'MicrosoftAzurePlugin*.log', 'Microsoft_Azure_*.log', 'NutanixAHV*.log', 'PVEPlugin*.log',
            'RHVPlugin*.log', 'ADExplorer.log', 'Exchange*.log', 'MongoDBExplorer.log', 'OracleExplorer.log', 'OracleLib.log',
            'PostgreSqlExplorer.log', 'SapHanaExplorer.log', 'SharePoint*.log', 'SmartObject.log', 'SQLExplorer.log', 'Disk.*.log',
            'Driver.VeeamFLR*.log', 'FilesysVss*.log', 'FLR_*.log', 'FlrDrv*.log', 'Audit*.log', 'Collector*.log',
            'Common.log', 'crash.Veeam.*.log', 'ExternalRepo*.log', 'Full.log', 'I_O_filter_deployment.log', 'InstallerSvc.log',
            'Listener.log', 'Main.log', 'OneAgent*.log', 'PluginImmutabilityUpdater.log', 'PostgresConfigurator_*.log', 'Record.log',
            'RemedyService*.log', 'ReplicationState*.log', 'Reports.log', 'ReportViewer.log', 'SaveMetaAgent*.log', 'ServiceFail.log',
            'Session.log', '*.logshipping.log', '*.ctrl.log', '*.ctrl_*.log', '[0-9][0-9].[0-9]*.log', '????????-????-????-????-????????????.log',
            'Veeam*.log',
        ],
        "content": r'^\[\d{2}\.\d{2}\.\d{4}\s\d{2}:\d{2}:\d{2}(?:\.\d+)?\]\s+<',
        "line": r'^\[(?P<timestamp>\d{2}\.\d{2}\.\d{4}\s\d{2}:\d{2}:\d{2})(?:\.\d+)?\]\s+<\s*(?P<thread>\d+)\s*>\s+(?:(?P<level>Info|Warning|Warn|Error|Err|Fatal|Critical|Debug|Verbose|Success|Trace)\s+)?(?P<message>.+)$',
        "levels": {
            'Critical': ['Critical', 'Fatal'],
            'Error': ['Error', 'Err'],
            'Warning': ['Warning', 'Warn'],
            'Info': ['Info', 'Success'],
            'Debug': ['Debug', 'Verbose', 'Trace'],
        },
        "overrides": {
            'Critical': [r'(?i)\bFATAL\b', r'(?i)\bCRITICAL\b'],
            'Error': [r'(?i)\bFailed\b', r'(?i)\bException\b', r'(?i)\bError\b', '(?i)Unable to', '(?i)Cannot '],
            'Warning': [r'(?i)\bWarn(ing)?\b', r'(?i)\bTimeout\b', r'(?i)\bRetry\b'],
            'Info': [r'(?i)\bSucceed\b', r'(?i)\bCompleted\b'],
        },
    },
    {
        "id": 'veeam-vbo365', "name": 'Veeam Backup for Microsoft 365', "mode": 'continuation', "format": '%-m/%-d/%Y %-I:%M:%S %p',
        "files": ['Veeam.Archiver.*.log', 'Veeam.Archiver.*_[0-9]*.log'],
        "content": r'^\d{1,2}/\d{1,2}/\d{4}\s\d{1,2}:\d{2}:\d{2}\s[AP]M\s\d+',
        "line": r'(?P<timestamp>\d{1,2}/\d{1,2}/\d{4}\s\d{1,2}:\d{2}:\d{2}\s[AP]M)\s(?P<component>\d+)\s\((?P<thread>\d+)\)\s(?P<message>.+)$',
        "levels": {
            'Critical': ['FATAL', 'CRITICAL'],
            'Error': ['Error', 'Failed', 'Exception', 'Cannot'],
            'Warning': ['Warning', 'Warn', 'Timeout', 'Retry'],
        },
    },
    {
        "id": 'iis-w3c', "name": 'IIS W3C Extended Log', "mode": 'skip', "format": '%Y-%m-%d %H:%M:%S',
        "files": ['u_ex*.log', 'u_in*.log'],
        "content": r'^(#Fields:|#Software: Microsoft Internet Information Services|\d{4}-\d{2}-\d{2}\s\d{2}:\d{2}:\d{2}\s)',
        "line": r'^(?P<timestamp>\d{4}-\d{2}-\d{2}\s\d{2}:\d{2}:\d{2})\s(?P<message>.+)$',
        "levels": {
            'Error': [' 500 ', ' 502 ', ' 503 ', ' 504 '],
            'Warning': [' 400 ', ' 401 ', ' 403 ', ' 404 ', ' 408 ', ' 429 '],
        },
    },
    {
        "id": 'syslog-rfc3164', "name": 'Syslog (BSD/RFC 3164)', "mode": 'continuation', "format": '%b %d %H:%M:%S',
        "files": ['syslog', 'syslog.[0-9]*', 'messages', 'messages.[0-9]*', 'auth.log', 'auth.log.[0-9]*'],
        "content": r'^[A-Z][a-z]{2}\s[\s\d]\d\s\d{2}:\d{2}:\d{2}\s\S+',
        "line": r'^(?P<timestamp>[A-Z][a-z]{2}\s[\s\d]\d\s\d{2}:\d{2}:\d{2})\s(?P<component>\S+)\s(?P<source>[^\[:\s]+)(?:\[(?P<thread>\d+)\])?:\s*(?P<message>.+)$',
        "levels": {
            'Critical': ['panic', 'emerg', 'CRITICAL'],
            'Error': ['err', 'error', 'crit', 'alert', 'Failed', 'failure'],
            'Warning': ['warning', 'warn'],
            'Info': ['notice', 'info'],
            'Debug': ['debug'],
        },
    },
    {
        "id": 'syslog-rfc5424', "name": 'Syslog (IETF/RFC 5424)', "mode": 'continuation', "format": '%Y-%m-%dT%H:%M:%S',
        "files": [],
        "content": r'^<\d+>\d\s\d{4}-\d{2}-\d{2}T',
        "line": r'^<\d+>\d\s(?P<timestamp>\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2}))\s(?P<component>\S+)\s(?P<source>\S+)\s(?P<thread>\S+)\s\S+\s(?:\S+\s)?(?P<message>.+)$',
        "levels": {
            'Critical': ['emerg', 'panic', 'CRITICAL'],
            'Error': ['err', 'error', 'crit', 'alert', 'Failed'],
            'Warning': ['warning', 'warn'],
            'Info': ['notice', 'info'],
            'Debug': ['debug'],
        },
    },
    {
        "id": 'json-lines', "name": 'JSON Lines (NDJSON)', "mode": 'skip', "format": '%Y-%m-%dT%H:%M:%S',
        "files": ['*.jsonl', '*.ndjson'],
        "content": r'^\s*\{',
        "line": r'^(?P<message>\{.+\})$',
        "levels": {
            'Critical': ['CRITICAL', 'FATAL', 'EMERGENCY'],
            'Error': ['ERROR', 'ERR'],
            'Warning': ['WARNING', 'WARN'],
            'Info': ['INFO', 'INFORMATION'],
            'Debug': ['DEBUG', 'TRACE', 'VERBOSE'],
        },
    },
    {
        "id": 'log4j-default', "name": 'Log4j / Logback Default', "mode": 'continuation', "format": '%Y-%m-%d %H:%M:%S',
        "files": [],
        "content": r'^\d{4}-\d{2}-\d{2}\s\d{2}:\d{2}:\d{2}[.,]\d{3}\s+(?:ERROR|WARN|INFO|DEBUG|TRACE|FATAL)\s+\[',
        "line": r'^(?P<timestamp>\d{4}-\d{2}-\d{2}\s\d{2}:\d{2}:\d{2})[.,]\d{3}\s+(?P<level>\w+)\s+\[(?P<thread>[^\]]+)\]\s+(?P<component>\S+)\s+-\s+(?P<message>.+)$',
        "levels": {
            'Critical': ['FATAL'],
            'Error': ['ERROR'],
            'Warning': ['WARN'],
            'Info': ['INFO'],
            'Debug': ['DEBUG', 'TRACE'],
        },
    },
    {
        "id": 'sql-server-error', "name": 'SQL Server Error Log', "mode": 'skip', "format": '%Y-%m-%d %H:%M:%S',
        "files": ['ERRORLOG', 'ERRORLOG.[0-9]', 'ERRORLOG.[0-9][0-9]'],
        "content": r'^\d{4}-\d{2}-\d{2}\s\d{2}:\d{2}:\d{2}\.\d{2}',
        "line": r'^(?P<timestamp>\d{4}-\d{2}-\d{2}\s\d{2}:\d{2}:\d{2})\.\d+\s(?P<component>\S+)\s+(?P<message>.+)$',
        "levels": {
            'Critical': ['severity: 20', 'severity: 21', 'severity: 22', 'severity: 23', 'severity: 24', 'severity: 25'],
            'Error': ['error:', 'login failed', 'failed to', 'cannot', 'unable to', 'access denied', 'exception', 'corrupt'],
            'Warning': ['warning:', 'deprecated', 'timeout', 'timed out', 'low memory', 'memory pressure', 'high cpu'],
            'Info': ['starting up', 'recovery', 'server listening', 'completed', 'configuration', 'restarting'],
            'Debug': ['dbcc', 'trace flag'],
        },
    },
    {
        "id": 'sql-server-agent', "name": 'SQL Server Agent Log', "mode": 'skip', "format": '%Y-%m-%d %H:%M:%S',
        "files": ['SQLAGENT.OUT', 'SQLAGENT.[0-9]', 'SQLAGENT.[0-9][0-9]'],
        "content": r'^\d{4}-\d{2}-\d{2}\s\d{2}:\d{2}:\d{2}\s-\s[?!+]\s\[',
        "line": r'^(?P<timestamp>\d{4}-\d{2}-\d{2}\s\d{2}:\d{2}:\d{2})\s-\s(?P<level>[?!+])\s\[(?P<thread>\d+)\]\s(?P<message>.+)$',
        "levels": {
            'Error': ['!'],
            'Info': ['?', '+'],
        },
    },
    {
        "id": 'apache-combined', "name": 'Apache / nginx Combined Access Log', "mode": 'skip', "format": '%d/%b/%Y:%H:%M:%S',
        "files": ['access.log', 'access.log.[0-9]*', 'access_log', 'access_log.[0-9]*', '*-access.log', '*_access.log'],
        "content": r'^\S+\s+\S+\s+\S+\s+\[\d{2}/\w{3}/\d{4}:\d{2}:\d{2}:\d{2}\s[+-]\d{4}\]',
        "line": r'^(?P<component>\S+)\s+\S+\s+\S+\s+\[(?P<timestamp>\d{2}/\w{3}/\d{4}:\d{2}:\d{2}:\d{2})\s[+-]\d{4}\]\s+(?P<message>"[^"]*"\s+\d{3}\s+.+)$',
        "overrides": {
            'Error': [r'" 5\d{2} '],
            'Warning': ['" 4[0-9]{2} '],
        },
    },
    {
        "id": 'nginx-error', "name": 'nginx Error Log', "mode": 'continuation', "format": '%Y/%m/%d %H:%M:%S',
        "files": ['error.log', 'error.log.[0-9]*', 'nginx-error.log', 'nginx_error.log', 'nginx-error.log.[0-9]*'],
        "content": r'^\d{4}/\d{2}/\d{2}\s\d{2}:\d{2}:\d{2}\s\[\w+\]\s+\d+#\d+:',
        "line": r'^(?P<timestamp>\d{4}/\d{2}/\d{2}\s\d{2}:\d{2}:\d{2})\s+\[(?P<level>\w+)\]\s+(?P<thread>\d+#\d+):\s+(?P<message>.+)$',
        "levels": {
            'Critical': ['emerg', 'alert', 'crit'],
            'Error': ['error', 'err'],
            'Warning': ['warn'],
            'Info': ['notice', 'info'],
            'Debug': ['debug'],
        },
    },
    {
        "id": 'windows-dhcp', "name": 'Windows DHCP Server Log', "mode": 'skip', "format": '%m/%d/%y,%H:%M:%S',
        "files": ['DhcpSrvLog-*.log', 'DhcpV6SrvLog-*.log'],
        "content": r'^\d{2},\d{2}/\d{2}/\d{2},\d{2}:\d{2}:\d{2},',
        "line": r'^(?P<thread>\d+),(?P<timestamp>\d{2}/\d{2}/\d{2},\d{2}:\d{2}:\d{2}),(?P<message>.+)$',
        "levels": {
            'Error': ['nack', 'bad address', 'conflict', 'not authorized', 'declined'],
            'Warning': ['expired', 'unreachable', 'paused', 'rogue'],
            'Info': ['assign', 'renew', 'release', 'started', 'stopped', 'authorized', 'update'],
        },
    },
    {
        "id": 'intune-ime', "name": 'Microsoft Intune Management Extension', "mode": 'skip', "format": '%m-%d-%Y',
        "files": ['IntuneManagementExtension*.log', 'AgentExecutor*.log', 'SidecarExtension*.log', 'EventCollector*.log', 'Microsoft.Management.Services.IntuneWindowsAgent.log'],
        "content": r'^<!\[LOG\[',
        "line": r'^<!\[LOG\[(?P<message>.*?)\]LOG\]!><time="[^"]+"\s+date="(?P<timestamp>\d{1,2}-\d{1,2}-\d{4})"\s+component="(?P<component>[^"]*)"\s+context="[^"]*"\s+type="(?P<level>\d)"\s+thread="(?P<thread>[^"]*)"\s+file="[^"]*">$',
        "levels": {
            'Error': ['3'],
            'Warning': ['2'],
            'Info': ['1'],
        },
    },
    {
        "id": 'windows-cluster', "name": 'Windows Failover Cluster Log', "mode": 'continuation', "format": '%Y/%m/%d-%H:%M:%S',
        "files": ['cluster.log', 'cluster.log.bak', 'cluster.log.[0-9]'],
        "content": r'^[0-9a-f]+\.[0-9a-f]+::\d{4}/\d{2}/\d{2}-\d{2}:\d{2}:\d{2}',
        "line": r'^(?P<thread>[0-9a-fA-F]+\.[0-9a-fA-F]+)::(?P<timestamp>\d{4}/\d{2}/\d{2}-\d{2}:\d{2}:\d{2})\.\d+\s+(?P<level>\w+)\s+(?P<message>.+)$',
        "levels": {
            'Error': ['ERR'],
            'Warning': ['WARN'],
            'Info': ['INFO'],
            'Debug': ['DBG', 'DBGPRINT', 'TRACE'],
        },
    },
    {
        "id": 'kubernetes-klog', "name": 'Kubernetes klog', "mode": 'continuation', "format": '%Y-%m-%d',
        "files": ['kube-apiserver.log', 'kube-scheduler.log', 'kube-controller-manager.log', 'kubelet.log', 'kube-proxy.log', 'etcd.log', 'kubernetes.log'],
        "content": r'^[IWEF]\d{4}\s\d{2}:\d{2}:\d{2}\.\d+\s',
        "line": r'^(?P<level>[IWEF])\d{4}\s\d{2}:\d{2}:\d{2}\.\d+\s+\d+\s+[^\]]+\]\s+(?P<message>.+)$',
        "levels": {
            'Critical': ['F'],
            'Error': ['E'],
            'Warning': ['W'],
            'Info': ['I'],
        },
    },
    {
        "id": 'exchange-tracking', "name": 'Microsoft Exchange Message Tracking Log', "mode": 'skip', "format": '%Y-%m-%dT%H:%M:%S',
        "files": ['MSGTRK*.LOG', 'MSGTRKMD*.LOG', 'MSGTRKMS*.LOG', 'MSGTRKMA*.LOG', 'MSGTRKE*.LOG', 'MSGTRKF*.LOG'],
        "content": r'^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d+Z,',
        "line": r'^(?P<timestamp>\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})\.\d+Z,(?P<message>.+)$',
        "overrides": {
            'Error': [r'(?i)\bFAIL\b', r'(?i)\bBADMAIL\b', r'(?i)\bQUARANTINE\b'],
            'Warning': [r'(?i)\bDELAY\b', r'(?i)\bREDIRECT\b', r'(?i)\bPOISON\b'],
            'Info': [r'(?i)\bRECEIVE\b', r'(?i)\bDELIVER\b', r'(?i)\bSEND\b', r'(?i)\bSUBMIT\b', r'(?i)\bRESOLVE\b', r'(?i)\bEXPAND\b', r'(?i)\bTRANSFER\b'],
        },
    },
    {
        "id": 'postgresql-log', "name": 'PostgreSQL Server Log', "mode": 'continuation', "format": '%Y-%m-%d %H:%M:%S%.f',
        "files": ['postgresql*.log', 'postgresql-*.log', 'postgres*.log', 'pgsql*.log'],
        "content": r'^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}[\d. A-Z]*\[\d+\] [A-Z]+',
        "line": r'^(?P<timestamp>\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(?:\.\d+)?)(?:\s+[A-Z]+)?\s+\[(?P<thread>\d+)\]\s+(?P<level>[A-Z][A-Z0-9]*):\s{1,2}(?P<message>.*)$',
        "levels": {
            'Critical': ['PANIC'],
            'Error': ['ERROR', 'FATAL'],
            'Warning': ['WARNING'],
            'Info': ['LOG', 'INFO', 'NOTICE', 'DETAIL', 'HINT', 'CONTEXT', 'STATEMENT'],
            'Debug': ['DEBUG', 'DEBUG1', 'DEBUG2', 'DEBUG3', 'DEBUG4', 'DEBUG5'],
        },
    },
    {
        "id": 'tomcat-catalina', "name": 'Apache Tomcat / Catalina Log', "mode": 'continuation', "format": '%d-%b-%Y %H:%M:%S%.f',
        "files": ['catalina.out', 'catalina.*.log', 'catalina*.log', 'localhost*.log', 'manager*.log', 'host-manager*.log'],
        "content": r'^\d{2}-[A-Z][a-z]{2}-\d{4} \d{2}:\d{2}:\d{2}\.\d+ (SEVERE|WARNING|INFO|CONFIG|FINE)',
        "line": r'^(?P<timestamp>\d{2}-\w{3}-\d{4} \d{2}:\d{2}:\d{2}\.\d+) (?P<level>SEVERE|WARNING|INFO|CONFIG|FINEST|FINER|FINE) \[(?P<thread>[^\]]+)\] (?P<component>\S+) (?P<message>.*)$',
        "levels": {
            'Error': ['SEVERE'],
            'Warning': ['WARNING'],
            'Info': ['INFO', 'CONFIG'],
            'Debug': ['FINEST', 'FINER', 'FINE'],
        },
    },
    {
        "id": 'sccm-cmtrace', "name": 'Microsoft SCCM / ConfigMgr (CMTrace)', "mode": 'skip', "format": '%m-%d-%Y',
        "files": [
            'smsts.log', 'smsts-*.log', 'AppEnforce.log', 'AppDiscovery.log', 'CcmExec.log', 'ClientIDManagerStartup.log',
            'PolicyAgent.log', 'PolicyEvaluator.log', 'UpdatesDeployment.log', 'UpdatesHandler.log', 'WUAHandler.log', 'SoftwareCenter.log',
            'execmgr.log', 'inventoryagent.log', 'LocationServices.log', 'ContentTransferManager.log', 'ccmsetup.log', 'RebootCoordinator.log',
            'ScanAgent.log', 'distmgr.log', 'replmgr.log', 'objreplmgr.log', 'hman.log', 'smsexec.log',
            'sitestat.log', 'MP_GetPolicy.log', 'StatusMessageReceiver.log', 'DcmWmiProvider.log', 'MaintenanceCoordinator.log', 'MTRMgr.log',
            'PatchDownloader.log',
        ],
        "content": r'^<!\[LOG\[',
        "line": r'^<!\[LOG\[(?P<message>.*?)\]LOG\]!><time="[^"]+"\s+date="(?P<timestamp>\d{1,2}-\d{1,2}-\d{4})"\s+component="(?P<component>[^"]*)"\s+context="[^"]*"\s+type="(?P<level>\d)"\s+thread="(?P<thread>[^"]*)"\s+file="[^"]*">$',
        "levels": {
            'Error': ['3'],
            'Warning': ['2'],
            'Info': ['1'],
        },
    },
    {
        "id": 'windows-firewall', "name": 'Windows Firewall Log', "mode": 'skip', "format": '%Y-%m-%d %H:%M:%S',
        "files": ['pfirewall.log', 'pfirewall.log.old', 'pfirewall*.log'],
        "content": r'^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2} (DROP|ALLOW)',
        "line": r'^(?P<timestamp>\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}) (?P<level>DROP-ICMP|ALLOW-ICMP|DROP|ALLOW) (?P<message>.+)$',
        "levels": {
            'Warning': ['DROP', 'DROP-ICMP'],
            'Info': ['ALLOW', 'ALLOW-ICMP'],
        },
    },
    {
        "id": 'generic-timestamp', "name": 'Generic Timestamp + Message', "mode": 'continuation', "format": '%Y-%m-%d %H:%M:%S',
        "files": [],
        "content": r'^\d{4}[-/]\d{2}[-/]\d{2}[\sT]\d{2}:\d{2}:\d{2}',
        "line": r'^(?P<timestamp>\d{4}[-/]\d{2}[-/]\d{2}[\sT]\d{2}:\d{2}:\d{2})\s+(?P<message>.+)$',
        "levels": {
            'Critical': ['CRITICAL', 'FATAL', 'EMERGENCY'],
            'Error': ['ERROR', 'ERR', 'FAIL', 'FAILED', 'Exception'],
            'Warning': ['WARNING', 'WARN'],
            'Info': ['INFO'],
            'Debug': ['DEBUG', 'TRACE', 'VERBOSE'],
        },
        "overrides": {
            'Critical': [r'\[CRIT(ICAL)?\]', r'\[FATAL\]'],
            'Error': [r'\[ERR(OR)?\]', r'\bException\b', r'\bStackTrace\b'],
            'Warning': [r'\[WARN(ING)?\]'],
            'Info': [r'\[INFO(RMATION)?\]'],
            'Debug': [r'\[DEBUG\]', r'\[TRACE\]', r'\[VERBOSE\]'],
        },
    },
    {
        "id": 'plain-text', "name": 'Plain Text (Unstructured)', "mode": 'raw', "format": '%Y-%m-%d %H:%M:%S',
        "files": [],
        "content": r'\S',
        "line": r'^(?P<message>.+)$',
        "levels": {
            'Critical': ['CRITICAL', 'FATAL'],
            'Error': ['ERROR', 'FAIL', 'FAILED', 'Exception'],
            'Warning': ['WARNING', 'WARN'],
        },
        "overrides": {
            'Critical': [r'\[CRIT(ICAL)?\]', r'\[FATAL\]', r'\bFatalException\b'],
            'Error': [r'\[ERR(OR)?\]', r'\bException\b', r'\bStackTrace\b', r'\bUnhandled\b'],
            'Warning': [r'\[WARN(ING)?\]', r'\bDeprecated\b'],
            'Info': [r'\[INFO(RMATION)?\]'],
            'Debug': [r'\[DEBUG\]', r'\[VERBOSE\]', r'\[TRACE\]'],
        },
    },
]
