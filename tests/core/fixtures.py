"""The inputs of a published two-step build, and the identifiers its documents have."""

#: Inputs of the object file, in log order.
OBJECT_INPUTS = """
29039dc7dd32210e38e949fcf483ec8ce6f7a054
c2ab78a2d4c20711295a501c61dd038bfa029934
739e08610d54f341cf14247ec38f254e1520e5b1
b4a429b83c345681b269bdee0785363f3d2c1f3c
5bed0a499605a3a26d55443f3c8b7e67de152f74
3f6fe3cc8563b49311327647fad53eb18d94da2c
70f652bca14d65c1de5a21669e7c0ffb8ecfe5ea
28488e0b05954ccf87c779f5f9258987e4d68ac5
70a1ba017357d3111cc510e73b269541ca2aaf09
477c8e4931c0d7191187acb42f0ed4255e3619aa
31b96a7e5e17f8da4cb8e6262869f643eddbd477
e4c73fd23a271b0b452cece0212ff244d2b55d48
64f344c6e7897491c7c7430f52ad06c61fa85dad
e6f7481a19cbc7857dbbfebef5adbeeaf80a70b8
bb04576651b9097b3027e4299cc30c88f334535f
1d8a4e28d1b62a2bfeba837fe18422cd106e6ddf
06a6891154fff74e1ddb6245f4a0467b09c617c5
06dd79bc831bb06a6267a36ad2d62beccd7900b2
f2682632090ba3e7f2caa1736394cbb235ceab0c
359f94945346c9eb4f92d1551e5e1a6d63a63dfb
1be90e6fab4ab9b7dd3b27cea5bb1fe29acc0204
4f725e95ffa2663083b66a557b12751261cbcf05
""".split()

#: Inputs of the program; the sixth is the object file.
PROGRAM_INPUTS = """
ff3b4838fba28e31dedd3703f4337107e6bc3ac0
fc3bd83b45151f219d7efeac952c567ddb9f86d0
596b81d3834f6f7f3aa888e09885505539c2f5ad
232fd2c41d204d23899069fc89e6516aab57421b
df02dffda2dc9c8a306829c31b540348165a3b92
6c7744ecf42790fb8073d0e822eb0a2b9b7c39e7
e4af8bf4f89bdb8bb6a890d8a9f07dce5c638138
3d5810339f0b219eb80dfa7cbd8883c3ef944351
""".split()

OBJECT = "6c7744ecf42790fb8073d0e822eb0a2b9b7c39e7"
PROGRAM = "dfad3d1a11801f146a94b2ad50024945b82efef6"

#: Documents of the two, with header.
OBJECT_BOM = "a94e51048ca7680bb5b10f0398304b272d4991ce"
PROGRAM_BOM = "fa2b94f83fefabaeee2ae5ebd680b76f23805f2b"

#: A document of four lines without header, and its identifier.
ARCHIVE_LINES = """
438bf647db266e2b7d71557436beda2ca21afb27 54e7d1011d2dbc7d786b4e07bd9216c89ae08d16
88eea30ff5cb11cc2c54c36ecbb7d350723d1063 c7d70100720bc7f329e8994e48d3e88611569861
b4661cd71c95124d8da0bfba6b97d1d1c313750b 1297782f73770700c5eea7fb66d07c6f1eeeabe9
b655de6691f64b0ecb445c68ff98815204c9f521 81e3016686ed2c4330a525254170cdc3e75be17c
""".strip().splitlines()
ARCHIVE_BOM = "41d33f44eb60cbe6d2760f7fdba536c2f362a38e"

#: A document of one line without header, and its identifier.
UNARY_LINE = "af4f09c6bbd7813b308541ae1659e7087d0de194 5e1750281326e9fe14f29adc0198fc24cc8964c6"
UNARY_BOM = "576e4e24b6af4311b4c51816fea2a21b1f152dbf"
